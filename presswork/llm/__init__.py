"""Operators for training data: text, duplicates, vectors, tokens, mixtures.

Nothing outside this folder imports it.
"""
