"""Operators for building text corpora: quality, toxicity, near duplicates, secrets, packing and search."""
