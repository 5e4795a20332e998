"""Operators for preparing training text: dedup, tokens, filters, formatting.

Nothing outside this subpackage imports it.
"""
