"""Operators for training-data pipelines: cleaning, deduplication, mixing and tokenizing of document tables.

Nothing else in the library imports this package. Each operator is a function ``DataFrame -> DataFrame`` in a module of
its own; ``queries`` registers one query for each.
"""
