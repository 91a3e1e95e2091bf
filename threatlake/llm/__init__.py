"""Operators that prepare training data: counting, encoding, cleaning, deduplication, search, sharding and mixing."""
