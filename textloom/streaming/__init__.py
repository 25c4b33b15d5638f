"""Structured Streaming over result folders."""
