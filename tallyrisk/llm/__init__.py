"""Operators that prepare training text: filtering, deduplication, archives, packing."""
