"""Operators of a training-data pipeline, and their registered queries.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
