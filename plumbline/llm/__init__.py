"""Corpus operators for training-data pipelines.

Nothing outside this package imports it; it can be deleted without touching the rest of the library.
"""
