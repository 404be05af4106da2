"""Corpus preparation for language models: filters, deduplication, packing, archives, tokens."""
