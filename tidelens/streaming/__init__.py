"""Structured Streaming versions of the operators that make sense online."""
