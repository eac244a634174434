"""Operators for preparing training text: similarity joins, tokens, quality, search, extraction, packing, secrets."""
