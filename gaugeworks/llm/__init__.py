"""Operators for training-data corpora: sharding, decontamination, deduplication, tokenizing, formatting, search and scoring.

Nothing outside this subpackage imports it.
"""
