"""Operators for preparing large-scale training corpora.  Nothing outside this package imports it."""
