"""Readers that turn foreign tables into canonical events, and writers for results."""
