"""Training-data operators: search, deduplication, mixing, quality, tokens, archives and packing.

Nothing else in the library imports this subpackage.
"""
