"""Operators for large text corpora.

Nothing else in the library imports this subpackage; it may import general
helpers (session, components) from the rest.
"""
