"""Structured Streaming encodings."""
