"""Operators for preparing training text: deduplication, sharding, tokenising, scoring and filtering of documents."""
