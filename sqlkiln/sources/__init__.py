"""Readers and writers for catalogs, corpora, prompts and results."""
