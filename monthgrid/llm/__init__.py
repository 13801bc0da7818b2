"""Operators for preparing text corpora, and the queries built on them."""
