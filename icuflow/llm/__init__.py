"""Operators for training-data text: duplicates, personal data, language, tokens, licences, toxicity, leaks, quality."""
