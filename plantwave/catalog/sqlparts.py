"""SQL fragments for the DuckDB twins of sequential operators."""

from __future__ import annotations

from .registry import READINGS_SQL

INDEXED = READINGS_SQL + """,
ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY us) AS rn, count(*) OVER (PARTITION BY tag) AS n FROM r)"""
BASELINE = INDEXED + """,
b AS MATERIALIZED (SELECT tag, avg(value) AS mean, greatest(stddev_samp(value), 1e-9) AS sigma, count(*) AS n_fit
 FROM ix WHERE rn <= floor(n * 0.25) GROUP BY tag)"""
SHEWHART = BASELINE + """,
v AS MATERIALIZED (SELECT ix.tag, us, value, CASE WHEN value > mean + 3 * sigma THEN 'above' ELSE 'below' END AS side,
 CASE WHEN value > mean + 3 * sigma THEN mean + 3 * sigma ELSE mean - 3 * sigma END AS lim, abs(value - mean) / sigma AS dev
 FROM ix JOIN b USING (tag) WHERE value > mean + 3 * sigma OR value < mean - 3 * sigma)"""
EWMA = BASELINE + """,
e AS (SELECT ix.tag, rn, us, value, 0.2 * value + 0.8 * mean AS ewma FROM ix JOIN b USING (tag) WHERE rn = 1
 UNION ALL SELECT ix.tag, ix.rn, ix.us, ix.value, 0.2 * ix.value + 0.8 * e.ewma FROM e JOIN ix ON ix.tag = e.tag AND ix.rn = e.rn + 1)"""
_STEP = """greatest(0.0, {p} + x - mean - 0.5 * sigma) AS a0, greatest(0.0, {q} - (x - mean) - 0.5 * sigma) AS b0"""
CUSUM = BASELINE + """,
c AS (SELECT tag, rn, us, value, mean, sigma, CASE WHEN a0 > 5 * sigma OR b0 > 5 * sigma THEN 0.0 ELSE a0 END AS a,
  CASE WHEN a0 > 5 * sigma OR b0 > 5 * sigma THEN 0.0 ELSE b0 END AS b, CASE WHEN a0 > 5 * sigma THEN 'upward'
  WHEN b0 > 5 * sigma THEN 'downward' END AS direction, CASE WHEN a0 > 5 * sigma THEN a0 ELSE b0 END AS s
 FROM (SELECT ix.*, mean, sigma, value AS x, greatest(0.0, value - mean - 0.5 * sigma) AS a0,
  greatest(0.0, -(value - mean) - 0.5 * sigma) AS b0 FROM ix JOIN b USING (tag) WHERE rn = 1)
 UNION ALL
 SELECT tag, rn, us, value, mean, sigma, CASE WHEN a0 > 5 * sigma OR b0 > 5 * sigma THEN 0.0 ELSE a0 END,
  CASE WHEN a0 > 5 * sigma OR b0 > 5 * sigma THEN 0.0 ELSE b0 END, CASE WHEN a0 > 5 * sigma THEN 'upward'
  WHEN b0 > 5 * sigma THEN 'downward' END, CASE WHEN a0 > 5 * sigma THEN a0 ELSE b0 END
 FROM (SELECT ix.tag, ix.rn, ix.us, ix.value, c.mean, c.sigma,
   greatest(0.0, c.a + ix.value - c.mean - 0.5 * c.sigma) AS a0, greatest(0.0, c.b - (ix.value - c.mean) - 0.5 * c.sigma) AS b0
   FROM c JOIN ix ON ix.tag = c.tag AND ix.rn = c.rn + 1))"""


def thin_sql(src: str, key: str, cooldown_us: int, strict: bool = True, name: str = "t") -> str:
    """Greedy thinning: follow each kept row to the first row that has cooled down."""
    reach = cooldown_us + 1 if strict else cooldown_us
    keys = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"n.{k} = k.{k}" for k in keys)
    cols = ", ".join(f"n.{k}" for k in keys)
    return f""",
{name}_n AS MATERIALIZED (SELECT *, min(us) OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {reach} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {src}),
{name}_k AS (SELECT {key}, min(us) AS us, arg_min(nxt, us) AS nxt FROM {name}_n GROUP BY {key}
 UNION ALL SELECT {cols}, n.us, n.nxt FROM {name}_k k JOIN (SELECT DISTINCT {key}, us, nxt FROM {name}_n) n ON {on} AND n.us = k.nxt),
{name} AS (SELECT n.* FROM {name}_n n SEMI JOIN {name}_k k ON {on} AND n.us = k.us)"""


def sessions_sql(src: str, key: str, gap_us: int, name: str = "s") -> str:
    """Gap islands; `src` needs us, value, lim, rank."""
    return f""",
{name}_g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY {key} ORDER BY us) > {gap_us}, true) AS opens FROM {src}),
{name}_i AS (SELECT *, max(CASE WHEN opens THEN us END) OVER (PARTITION BY {key} ORDER BY us) AS start_us FROM {name}_g),
{name} AS (SELECT {key}, start_us, max(us) AS end_us, count(*) AS alert_count, max(rank) AS peak_rank,
 first(value ORDER BY rank DESC, abs(value - lim) DESC, us) AS peak_value, first(us ORDER BY rank DESC, abs(value - lim) DESC, us) AS peak_us
 FROM {name}_i GROUP BY {key}, start_us)"""


SIGMA_RANK = "CASE WHEN dev > 8 THEN 4 WHEN dev > 5 THEN 3 WHEN dev > 3.5 THEN 2 ELSE 1 END"
