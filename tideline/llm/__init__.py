"""Training-data operators: scoring, search, tokens, deduplication, filters and mixing.

Nothing outside this subpackage imports it.
"""
