"""Readers and the fixed schemas of the article tables."""
