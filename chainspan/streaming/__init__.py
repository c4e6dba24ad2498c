"""Continuous capture with Structured Streaming."""
