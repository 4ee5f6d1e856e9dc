"""Code-security analytics as Spark jobs over tables of source files."""

__version__ = "0.1.0"
