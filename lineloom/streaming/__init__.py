"""Structured Streaming over commit feeds."""
