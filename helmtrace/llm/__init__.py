"""Operators for text collections: quality, tokens, extraction, duplicates, personal data, packing."""
