"""Operators for preparing text corpora: scoring, deduplication, privacy, sampling and tokenisation."""
