"""Operators for preparing text corpora: cleaning, deduplication, mixing, sharding, search, tokens.

Nothing else in the library imports this subpackage. Each module holds one operator with a
general interface; ``queries`` holds the thin registered queries over the given tables.
"""
