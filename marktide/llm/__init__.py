"""Corpus preparation for language-model training: filtering, deduplication, extraction, mixing, packing and output.

Nothing outside this subpackage imports it.
"""
