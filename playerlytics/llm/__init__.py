"""Operators for preparing training data: search, near-duplicates, filters, tokenizers, packing."""
