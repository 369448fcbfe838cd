"""Operators for preparing training data: deduplication, search, packing,
tokenization, scoring, and filters for quality, secrets and personal data.

Nothing outside this subpackage imports it.
"""
