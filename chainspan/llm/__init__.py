"""Operators of a training-data pipeline over tables of documents and web pages.

Nothing outside this subpackage imports it. Each operator is a module with its own interface; ``queries`` registers one
query per operator over its whole table.
"""
