"""Operators for building training corpora: text cleaning, joins, tokens and packing."""
