"""Operators for text and source corpora. Nothing outside this package imports it."""
