"""Ordered primitives that work on (series, time chunk) partitions.

Whole-series results come in two levels: a small per-chunk summary is scanned per
series (a row per chunk, never a row per reading) and joined back on
``(series, chunk)``; inside a chunk an ordinary window does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import CHUNK, with_chunk

BEFORE = (Window.unboundedPreceding, -1)


def as_found(result: DataFrame, given: DataFrame) -> DataFrame:
    """Primitives drop the chunk column unless their input already had it."""
    return result if CHUNK in given.columns else result.drop(CHUNK)


def ordered_window(keys: Sequence[str], order: Sequence, seconds: int | None) -> Window:
    parts = list(keys) + ([CHUNK] if seconds else [])
    return Window.partitionBy(*parts).orderBy(*order)


def chunk_carry(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column],
                carry: dict[str, Column], params: DataFrame | None = None) -> DataFrame:
    """Join carried-in values onto a chunked frame.

    `aggs` summarises a chunk; `carry` maps output names to expressions built with
    :func:`before` / :func:`after` / :func:`overall` over the summary.
    `params` (a row per series) rides along on the summary, which keeps the join of
    per-series parameters balanced even when one series holds most rows.
    """
    summary = df.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in aggs.items()])
    summary = summary.select(*keys, CHUNK, *[c.alias(n) for n, c in carry.items()])
    if params is not None:
        summary = summary.join(params, list(keys))
    return df.join(summary, [*keys, CHUNK])


def before(keys: Sequence[str], agg: Column) -> Column:
    return agg.over(Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*BEFORE))


def after(keys: Sequence[str], agg: Column) -> Column:
    # from the other end: a frame without an end is computed anew for every row
    return agg.over(Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(*BEFORE))


def overall(keys: Sequence[str], agg: Column) -> Column:
    return agg.over(Window.partitionBy(*keys))


def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence, ts: str = "ts",
               seconds: int | None = None, params: DataFrame | None = None,
               rn: str = "rn", total: str = "n_rows") -> DataFrame:
    """1-based row number and row count of every series, optionally with parameters."""
    w = ordered_window(keys, order, seconds)
    if not seconds:
        if params is not None:
            df = df.join(params, list(keys))
        return (df.withColumn(rn, F.row_number().over(w).cast("long"))
                  .withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    d = chunk_carry(
        with_chunk(df, ts, seconds), keys,
        {"__n": F.count(F.lit(1))},
        {"__before": F.coalesce(before(keys, F.sum("__n")), F.lit(0)),
         total: overall(keys, F.sum("__n"))},
        params,
    )
    return as_found(d.withColumn(rn, F.row_number().over(w) + F.col("__before")).drop("__before"), df)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str,
                   ts: str = "ts", seconds: int | None = None) -> DataFrame:
    """`lag(value)` over the whole series, across chunk borders."""
    w = ordered_window(keys, order, seconds)
    if not seconds:
        return df.withColumn(out, F.lag(value).over(w))
    # one tie-safe "largest row" per chunk, carried to the next non-empty chunk
    marker = F.struct(*[_plain(o) for o in order], F.col(value).alias("__v"))
    d = chunk_carry(
        with_chunk(df, ts, seconds), keys,
        {"__m": F.max(marker)},
        {"__lag": before(keys, F.max("__m")).getField("__v")},
    )
    first = F.row_number().over(w) == 1
    return as_found(d.withColumn(out, F.when(first, F.col("__lag")).otherwise(F.lag(value).over(w)))
                    .drop("__lag"), df)


def _plain(order) -> Column:
    return F.col(order) if isinstance(order, str) else order


def with_halo(df: DataFrame, keys: Sequence[str], rows_before: int, rows_after: int = 0,
              block_rows: int | None = None, rn: str = "rn") -> tuple[DataFrame, list[str], Column]:
    """Blocks of `block_rows` consecutive rows plus the neighbours a row frame needs.

    Returns (frame, partition columns, is-own-row predicate).  Rows near a block
    edge are duplicated into the adjacent block, so a finite ROWS frame computed
    per block equals the one over the whole series.
    """
    if not block_rows:
        return df, list(keys), F.lit(True)
    df = df.drop(CHUNK)
    block_rows = max(block_rows, rows_before, rows_after, 1)
    own = F.floor((F.col(rn) - 1) / block_rows)
    pos = (F.col(rn) - 1) % block_rows
    homes = F.array_compact(F.array(
        own,
        F.when(pos >= block_rows - rows_before, own + 1),
        F.when((pos < rows_after) & (own > 0), own - 1),
    ))
    d = df.withColumn("_own", own).withColumn("_block", F.explode(homes))
    return d, [*keys, "_block"], F.col("_own") == F.col("_block")


def row_frame(parts: Sequence[str], rn: str, start: int, end: int) -> Window:
    return Window.partitionBy(*parts).orderBy(rn).rowsBetween(start, end)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, out: str,
                  ts: str = "ts", seconds: int | None = None) -> DataFrame:
    """Running sum including the current row."""
    w = ordered_window(keys, order, seconds)
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__x", value)
    if not seconds:
        return d.withColumn(out, F.sum("__x").over(frame)).drop("__x")
    d = chunk_carry(with_chunk(d, ts, seconds), keys, {"__s": F.sum("__x")},
                    {"__base": F.coalesce(before(keys, F.sum("__s")), F.lit(0))})
    return as_found(d.withColumn(out, F.sum("__x").over(frame) + F.col("__base")).drop("__x", "__base"), df)


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, out: str,
               ts: str = "ts", seconds: int | None = None) -> DataFrame:
    """Latest non-null `value` at or before each row (forward fill)."""
    w = ordered_window(keys, order, seconds).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__x", value)
    if not seconds:
        return d.withColumn(out, F.last("__x", ignorenulls=True).over(w)).drop("__x")
    marker = F.struct(*[_plain(o) for o in order], F.col("__x"))
    d = chunk_carry(
        with_chunk(d, ts, seconds), keys,
        {"__m": F.max(F.when(F.col("__x").isNotNull(), marker))},
        {"__lag": before(keys, F.max("__m")).getField("__x")},
    )
    return as_found(d.withColumn(out, F.coalesce(F.last("__x", ignorenulls=True).over(w), F.col("__lag")))
                    .drop("__x", "__lag"), df)


def next_known(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, out: str,
               ts: str = "ts", seconds: int | None = None) -> DataFrame:
    """Earliest non-null `value` at or after each row (backward fill).

    The window runs backwards: in a frame without an end every row would cost all rows after it.
    """
    w = ordered_window(keys, [_plain(o).desc() for o in order], seconds).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__x", value)
    if not seconds:
        return d.withColumn(out, F.last("__x", ignorenulls=True).over(w)).drop("__x")
    marker = F.struct(*[_plain(o) for o in order], F.col("__x"))
    d = chunk_carry(
        with_chunk(d, ts, seconds), keys,
        {"__m": F.min(F.when(F.col("__x").isNotNull(), marker))},
        {"__lead": after(keys, F.min("__m")).getField("__x")},
    )
    return as_found(d.withColumn(out, F.coalesce(F.last("__x", ignorenulls=True).over(w), F.col("__lead")))
                    .drop("__x", "__lead"), df)
