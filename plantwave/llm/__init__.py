"""Operators for large training-data pipelines: texts, pages, conversations and vectors.

Nothing outside this folder imports it.
"""
