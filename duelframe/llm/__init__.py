"""Operators for preparing training text: dedup, tokenisation, classification, mixing, media and search."""
