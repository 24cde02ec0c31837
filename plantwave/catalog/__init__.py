"""Queries over the given tables, one per operator."""

from __future__ import annotations


def load():
    """(queries, sql), importing every catalogue module once."""
    from . import history, learning, series, trail, versions  # noqa: F401
    from .registry import QUERIES, SQL
    return QUERIES, SQL
