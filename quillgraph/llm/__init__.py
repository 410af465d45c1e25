"""Operators for preparing training data: deduplication, filters, language ID, tokens, packing."""
