"""Operators for large training-data pipelines over ``documents``.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered
queries; each operator has a module with a general interface and its documented
results for nulls, empty texts, ties, repeated rows and empty tables.
"""
