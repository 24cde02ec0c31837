"""Deterministic identifiers: the same content always gets the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """128 bits of the parts' content.

    Separators inside a part are escaped and a null has a mark no part can have, so different parts never
    make the same text.
    """
    escaped = [F.regexp_replace(p.cast("string"), r"([\\\\|~])", r"\\$1") for p in parts]
    text = F.concat_ws("|", *[F.coalesce(p, F.lit("~")) for p in escaped])
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(text, 256), 1, 32)))
