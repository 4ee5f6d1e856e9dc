"""Reading source trees and repository tables, writing results."""
