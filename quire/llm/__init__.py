"""Operators of a training-data pipeline: one module each, helpers shared only among themselves.

Queries and SQL are in :mod:`quire.llm.queries`; nothing outside this
subpackage imports it but the entry module and ``corpus_pipeline.py``.
"""
