"""Operators for preparing training data: search, filters, near copies, tokenizers and packing."""
