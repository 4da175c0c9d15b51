"""Operators of a training-data pipeline: scoring, search, near-dedup, filters, mixing, sharding and tokenizing.

Nothing else in the library imports this package.
"""
