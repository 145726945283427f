"""Operators for preparing training text: deduplication, tokens, language, mixing, scoring."""
