"""Operators of a training-data pipeline: duplicates, quality, toxicity, tokens, packing.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` applies them to the tables.
"""
