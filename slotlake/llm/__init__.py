"""Operators for text corpora: tokens, duplicates, mixtures, toxicity, secrets, personal data."""
