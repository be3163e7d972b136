"""Operators for preparing training text: language, duplicates, leaks, personal data, tokens, search."""
