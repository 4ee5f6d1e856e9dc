"""Structured Streaming versions of detection, cost and status logic."""
