"""Operators for large training corpora (tokens, shards, duplicates, quality).

Nothing outside this subpackage imports it.
"""
