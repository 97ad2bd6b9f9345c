"""Operators that prepare text for training: deduplication, tokens, packing, extraction, scoring."""
