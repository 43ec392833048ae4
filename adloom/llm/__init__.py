"""Operators for language-model training data: counting, cleaning, deduplication, formatting, packing, archives."""
