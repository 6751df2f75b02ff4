"""Structured Streaming jobs over arriving articles."""
