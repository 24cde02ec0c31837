"""Operating points: objectives, skyline, ranks, crowding and gap analysis."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_dir
from .ordered import chunk_carry, after, before
from .scale import CHUNK, TARGET_ROWS

#: Rows of one side of a group, rows of a grid cell, about, and grid cells at most.
SLICE = 20_000
CELL = 2_000
MOST_CELLS = 1_000
#: Distinct vectors that are ranked in one job.
RANK_SLICE = 50_000


def uniform_points(spark: SparkSession, n: int, bounds: dict[str, tuple[float, float]],
                   fixed: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """`n` candidate points uniform in the bounds; the id decides the draw."""
    d = spark.range(n).withColumnRenamed("id", "point_id")
    for i, (name, (lo, hi)) in enumerate(bounds.items()):
        u = F.pmod(F.xxhash64("point_id", F.lit(seed + i)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        d = d.withColumn(name, lo + (hi - lo) * u)
    for name, v in (fixed or {}).items():
        d = d.withColumn(name, F.lit(float(v)))
    return d


def signed(objectives: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Objective columns with lower always better; input (column, maximize|minimize)."""
    return {f"_o{i}": (-F.col(c) if d == "maximize" else F.col(c)).cast("double")
            for i, (c, d) in enumerate(objectives)}


def _dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which `points` some row of `by` dominates; `by` is walked in small blocks."""
    out = np.zeros(len(points), bool)
    for start in range(0, len(by), 64):
        block = by[start:start + 64]
        live = np.flatnonzero(~out)
        if not len(live):
            break
        p = points[live, None, :]
        no_worse = (block[None, :, :] <= p).all(2)
        better = (block[None, :, :] < p).any(2)
        out[live] = (no_worse & better).any(1)
    return out


def local_skyline(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop points dominated inside their own Arrow batch: exact, as dominance is transitive."""
    def prune(batches):
        best = None
        for pdf in batches:
            pdf = pdf[pdf[cols].notna().all(axis=1)]
            order = np.argsort(pdf[cols].to_numpy().sum(1), kind="stable")
            pts = pdf[cols].to_numpy()[order]
            keep = np.ones(len(pts), bool)
            if best is not None and len(pts):
                keep &= ~_dominated(pts, best)
            idx = np.flatnonzero(keep)
            for start in range(0, len(idx), 512):
                part = idx[start:start + 512]
                ahead = pts[idx[:start + 512][keep[idx[:start + 512]]]]
                keep[part] &= ~_dominated(pts[part], ahead)
            kept = pts[keep]
            best = kept[:2048] if best is None else best
            yield pdf.iloc[order[keep]]
    return df.mapInPandas(prune, df.schema)


# --- cells: only those that can dominate meet ---------------------------------------------------------

def with_cells(df: DataFrame, cols: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Add `_cell`, the number of the grid cell; `cuts` are the inner borders per objective."""
    cell = F.lit(0).cast("long")
    for c, at in zip(cols, cuts):
        if len(at):
            cell = cell * (len(at) + 1) + F.size(F.filter(F.array(*map(F.lit, at)), _below(F.col(c))))
    return df.withColumn("_cell", cell)


def _below(value: Column):
    return lambda border: border < value


def grid_cuts(df: DataFrame, cols: Sequence[str], rows: int, cell_rows: int) -> list[list[float]]:
    """Quantile borders per objective for about rows / cell_rows cells, `MOST_CELLS` at most."""
    cells = min(MOST_CELLS, max(1, -(-rows // cell_rows)))
    side = max(1, round(cells ** (1 / len(cols))))
    if side == 1:
        return [[] for _ in cols]
    found = df.approxQuantile(list(cols), [i / side for i in range(1, side)], 0.25 / side)
    return [sorted(set(f)) for f in found]


def cell_boxes(df: DataFrame, cols: Sequence[str]) -> pd.DataFrame:
    """Per non-empty cell its rows and the corners of the box around them: as many rows as cells, whatever the table."""
    box = [a for c in cols for a in (F.min(c).alias(f"lo{c}"), F.max(c).alias(f"hi{c}"))]
    return df.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *box).toPandas().sort_values("_cell", ignore_index=True)


def _corners(boxes: pd.DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return boxes[[f"lo{c}" for c in cols]].to_numpy(float), boxes[[f"hi{c}" for c in cols]].to_numpy(float)


def _all_dominate(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """[i, j]: every point of a box with upper corner hi[i] dominates every point of one with lower corner lo[j]."""
    return (hi[:, None] <= lo[None]).all(2) & (hi[:, None] < lo[None]).any(2)


def meeting_cells(boxes: pd.DataFrame, cols: Sequence[str]) -> list[tuple[int, int]]:
    """(cell, cell whose points may dominate some of it): none of a cell that another one dominates as a whole."""
    lo, hi = _corners(boxes, cols)
    alive = np.flatnonzero(~_all_dominate(hi, lo).any(0))
    may = (lo[alive][:, None] <= hi[alive][None]).all(2)
    cell = boxes["_cell"].to_numpy()[alive]
    return [(int(cell[j]), int(cell[i])) for i, j in np.argwhere(may)]


def gaining_cells(asked: pd.DataFrame, held: pd.DataFrame, cols: Sequence[str], weights: np.ndarray) -> list[tuple[int, int]]:
    """(cell of current points, cell of the front whose points may be the best gain for some of them).

    A front cell is out when every point of another one dominates all current points of the cell and has a smaller
    weighted sum than any of its own.
    """
    (lo, hi), (flo, fhi) = _corners(asked, cols), _corners(held, cols)
    may = (flo[:, None] <= hi[None]).all(2)
    sure = np.where(_all_dominate(fhi, lo), (fhi @ weights)[:, None], np.inf).min(0)
    may &= (flo @ weights)[:, None] <= sure[None] + 1e-9 * (1 + np.abs(np.where(np.isfinite(sure), sure, 0)))
    mine, other = asked["_cell"].to_numpy(), held["_cell"].to_numpy()
    return [(int(mine[j]), int(other[i])) for i, j in np.argwhere(may)]


def _meet(left: DataFrame, right: DataFrame, pairs: list[tuple[int, int]], left_parts: dict[int, int],
          right_parts: dict[int, int], names: Sequence[str], right_names: Sequence[str]) -> tuple:
    """Both sides grouped by (left cell, right cell, part, part): a row goes to the cells its own may meet only.

    A cell above the bound is cut into parts by a hash, so that a group is never larger than two bounds.
    """
    spark = left.sparkSession
    rows = [(a, b, left_parts[a], right_parts[b]) for a, b in pairs]
    spread = lambda d, n: F.pmod(F.xxhash64(*d), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.join(F.broadcast(spark.createDataFrame(rows, "_cell long, _b long, _pa int, _pb int")), "_cell").withColumn(
        "_a", F.col("_cell")).withColumn("_x", spread(names, "_pa")).withColumn("_y", every("_pb"))
    two = right.join(F.broadcast(spark.createDataFrame(rows, "_a long, _cell long, _pa int, _pb int")), "_cell").withColumn(
        "_b", F.col("_cell")).withColumn("_y", spread(right_names, "_pb")).withColumn("_x", every("_pa"))
    keys = ["_a", "_b", "_x", "_y"]
    fresh = lambda d, own: d.select(*keys, *own).toDF(*keys, *own).groupBy(*keys)  # noqa: E731  (both may be one table)
    return fresh(one, names), fresh(two, right_names)


def _parts(boxes: pd.DataFrame, rows: int) -> dict[int, int]:
    return {int(c): max(1, -(-int(n) // rows)) for c, n in zip(boxes["_cell"], boxes["n"])}


def pareto_front(df: DataFrame, objectives: Sequence[tuple[str, str]], slice_rows: int = SLICE,
                 cell_rows: int = CELL) -> DataFrame:
    """Points no other point dominates (equal points all stay; one with a null objective is no point).

    A local pass prunes each batch.  The distinct vectors left are dealt into grid cells; cells that another one
    dominates as a whole go, and a cell meets only those whose box reaches below its own.  Losers are removed by
    an anti join.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cols_map = signed(objectives)
    cols = list(cols_map)
    d = local_skyline(df.withColumns(cols_map), cols).checkpoint()
    vectors = d.select(*cols).distinct().checkpoint()
    n = vectors.count()
    if n == 0:
        return d.drop(*cols)
    cuts = grid_cuts(vectors, cols, n, cell_rows)
    celled = with_cells(vectors, cols, cuts)
    boxes = cell_boxes(celled, cols)
    pairs = meeting_cells(boxes, cols)
    parts = _parts(boxes, slice_rows)
    mine, other = _meet(celled, celled, pairs, parts, parts, cols, cols)

    def losers(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by = right[cols].to_numpy()
        return left.loc[_dominated(left[cols].to_numpy(), by[np.argsort(by.sum(1), kind="stable")]), cols]

    lost = mine.cogroup(other).applyInPandas(losers, vectors.schema)
    alive = df.sparkSession.createDataFrame(sorted({(a,) for a, _ in pairs}), "_cell long")
    kept = celled.join(F.broadcast(alive), "_cell").select(*cols).join(lost.distinct(), cols, "left_anti")
    return d.join(kept, cols, "left_semi").drop(*cols)


# --- ranks: the longest chain of dominators -----------------------------------------------------------

class Staircases:
    """Points by rank, kept as what later points can still meet: per rank those no other one is below in all but the first objective."""

    def __init__(self, rest: np.ndarray, ranks: np.ndarray):
        self.steps = [rest[ranks == r] for r in range(int(ranks.max(initial=-1)) + 1)]

    def add(self, rank: int, rest: Sequence[float]) -> None:
        rest = np.asarray(rest)
        if rank == len(self.steps):
            self.steps.append(np.empty((0, len(rest))))
        at = self.steps[rank]
        if not (at <= rest).all(1).any():
            self.steps[rank] = np.vstack([at[~(rest <= at).all(1)], rest])

    def rank(self, rest: Sequence[float]) -> int:
        """The first rank without a dominator; ranks below it have one each, so halving finds it."""
        rest = np.asarray(rest)
        low, high = 0, len(self.steps)
        while low < high:
            middle = (low + high) // 2
            if (self.steps[middle] <= rest).all(1).any():
                low = middle + 1
            else:
                high = middle
        return low

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        return np.vstack(self.steps), np.repeat(np.arange(len(self.steps)), [len(s) for s in self.steps])


class Reach:
    """The highest rank among points that are no worse in up to two objectives, for what `Staircases` does for any number.

    A binary indexed tree over the first of them holds in each node the second in ascending order, with ranks that
    rise along it.  A point costs some bisections, however many ranks there are.  What is kept are the points that none
    of the same or a higher rank is below: with few different values they are few, whatever the number of ranks.
    """

    def __init__(self, rest: np.ndarray, ranks: np.ndarray, coming: np.ndarray):
        self.dims = rest.shape[1]
        firsts = np.concatenate([rest[:, 0], coming[:, 0]]) if self.dims else np.zeros(1)
        self.firsts = np.unique(firsts).tolist()
        self.nodes = [([], []) for _ in range(len(self.firsts) + 1)]
        self.points = []
        for row, rank in zip(rest.tolist(), ranks.tolist()):
            self.add(rank, row)

    def _two(self, rest: Sequence[float]) -> tuple[float, float]:
        return (rest[0] if self.dims else 0.0), (rest[1] if self.dims > 1 else 0.0)

    def add(self, rank: int, rest: Sequence[float]) -> None:
        a, b = self._two(rest)
        self.points.append((-rank, a, b))
        i = bisect_left(self.firsts, a) + 1
        while i < len(self.nodes):
            seconds, ranks = self.nodes[i]
            at = bisect_right(seconds, b)
            if not at or ranks[at - 1] < rank:
                start = end = bisect_left(seconds, b)
                while end < len(ranks) and ranks[end] <= rank:
                    end += 1
                seconds[start:end], ranks[start:end] = [b], [rank]
            i += i & -i

    def rank(self, rest: Sequence[float]) -> int:
        a, b = self._two(rest)
        i, top = bisect_right(self.firsts, a), -1
        while i:
            seconds, ranks = self.nodes[i]
            at = bisect_right(seconds, b)
            if at and ranks[at - 1] > top:
                top = ranks[at - 1]
            i -= i & -i
        return top + 1

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        out, xs, ys = [], [], []
        for point in sorted(self.points):
            _, a, b = point
            at = bisect_right(xs, a)
            if at and ys[at - 1] <= b:
                continue
            out.append(point)
            start = end = bisect_left(xs, a)
            while end < len(ys) and ys[end] >= b:
                end += 1
            xs[start:end], ys[start:end] = [a], [b]
        found = np.array(out, float).reshape(-1, 3)
        return found[:, 1:1 + self.dims], -found[:, 0].astype("int64")


def rank_slice(points: np.ndarray, stairs: Staircases | Reach) -> np.ndarray:
    """Ranks of distinct points that all come after those in `stairs` in ascending order of their objectives.

    A dominator comes earlier in that order, and an earlier point that is no worse in all but the first objective is one.
    """
    ranks = np.zeros(len(points), dtype=np.int32)
    rest = points[:, 1:].tolist()
    for i in np.lexsort(points.T[::-1]).tolist():
        ranks[i] = rank = stairs.rank(rest[i])
        stairs.add(rank, rest[i])
    return ranks


def _all_ranks(df: DataFrame, objectives: Sequence[tuple[str, str]], slice_rows: int, job_rows: int) -> DataFrame:
    spark = df.sparkSession
    cols_map = signed(objectives)
    cols = list(cols_map)
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    # kept, as sums in another order need not give the same vector again
    d = df.withColumns(cols_map).checkpoint()
    vectors = d.filter(whole).select(*cols).distinct().checkpoint()
    n = vectors.count()
    if not n:
        return df.withColumn("rank", F.lit(None).cast("int"))
    base = f"{shared_dir(spark)}/ranks-{uuid.uuid4().hex}"
    vectors.repartitionByRange(-(-n // max(slice_rows, job_rows)), *cols).withColumn(
        "_job", F.spark_partition_id()).write.partitionBy("_job").parquet(f"{base}/points")
    order = [r[0] for r in spark.read.parquet(f"{base}/points").select("_job").distinct().orderBy("_job").collect()]
    point_ddl = ", ".join(f"{c} double" for c in cols)
    ranked_ddl = f"{point_ddl}, rank int, _stair boolean"

    def step(points: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        x = points[cols].sort_values(cols).to_numpy(float)
        held_rest, held_ranks = held[cols[1:]].to_numpy(float), held["rank"].to_numpy("int64")
        stairs = Reach(held_rest, held_ranks, x[:, 1:]) if len(cols) <= 3 else Staircases(held_rest, held_ranks)
        ranks = [rank_slice(x[i:i + slice_rows], stairs) for i in range(0, len(x), slice_rows)]
        ranked = pd.DataFrame(x, columns=cols).assign(rank=np.concatenate(ranks), _stair=False)
        rest, at = stairs.kept()
        steps = pd.DataFrame(np.hstack([np.zeros((len(rest), 1)), rest]), columns=cols).assign(rank=at, _stair=True)
        return pd.concat([ranked, steps], ignore_index=True).astype({"rank": "int32"})

    held = spark.createDataFrame([], ranked_ddl)
    for k in order:
        points = spark.read.schema(point_ddl).parquet(f"{base}/points/_job={k}").groupBy(F.lit(0).alias("_g"))
        points.cogroup(held.groupBy(F.lit(0).alias("_g"))).applyInPandas(step, ranked_ddl).write.parquet(f"{base}/ranked-{k}")
        held = spark.read.schema(ranked_ddl).parquet(f"{base}/ranked-{k}").filter("_stair")
    done = spark.read.schema(ranked_ddl).parquet(*[f"{base}/ranked-{k}" for k in order]).filter("NOT _stair").drop("_stair")
    return d.join(done, cols, "left").drop(*cols)


def pareto_ranks(df: DataFrame, objectives: Sequence[tuple[str, str]], id_column: str,
                 max_rank: int | None = None, at_least: int | None = None, slice_rows: int = RANK_SLICE,
                 job_rows: int = RANK_SLICE) -> DataFrame:
    """The rank of every point: the length of its longest chain of dominators, 0 on the front.

    Distinct vectors are sorted and ranked in slices of `slice_rows`, each behind what is left to meet of the points
    before it; a job takes the slices of about `job_rows` vectors, reads these only and hands on what is left to meet,
    whose size follows the surface of the data, not its rows, and not the number of fronts.  Points with a null
    objective get rank null.

    With `max_rank` or `at_least` only the first fronts are peeled, one after another, up to that rank or until so
    many points have a rank, which is all that a selection of that many needs; deeper points get rank null.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if max_rank is None and at_least is None:
        return _all_ranks(df, objectives, slice_rows, job_rows)
    rest, out, r, held = df, None, 0, 0
    while (max_rank is None or r <= max_rank) and (at_least is None or held < at_least):
        front = pareto_front(rest, objectives).withColumn("rank", F.lit(r)).checkpoint()
        n = front.count()
        if r and not n:
            break
        out, held, r = front if out is None else out.unionByName(front), held + n, r + 1
        rest = rest.join(front.select(id_column), id_column, "left_anti").checkpoint()
        if not n:
            break
    return out.unionByName(rest.withColumn("rank", F.lit(None).cast("int")))


def crowding(front: DataFrame, objectives: Sequence[tuple[str, str]], id_column: str,
             group: Sequence[str] = ("rank",), max_group_rows: int = TARGET_ROWS) -> DataFrame:
    """Distance to the neighbours per objective; the ends of each objective are infinite.

    Ties are ordered by id.  Groups beyond `max_group_rows` are cut by value into chunks
    whose border values are carried over.
    """
    group = list(group)
    cols_map = signed(objectives)
    d = front.withColumns(cols_map)
    sizes = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    long = d.select(*group, F.col(id_column).alias("_id"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(c).alias("_v")) for i, c in enumerate(cols_map)])).alias("x")
    ).select(*group, "_id", "x.*")
    keys = [*group, "_i"]
    if largest <= max_group_rows:
        w = Window.partitionBy(*keys).orderBy("_v", "_id")
        every = Window.partitionBy(*keys)
        long = (long.withColumn("_p", F.lag("_v").over(w)).withColumn("_n", F.lead("_v").over(w))
                .withColumn("_spread", F.max("_v").over(every) - F.min("_v").over(every))
                .withColumn("_size", F.count(F.lit(1)).over(every)))
    else:
        parts = int(2 * largest / max_group_rows) + 1
        cuts = long.approxQuantile("_v", [i / parts for i in range(1, parts)], 0.5 / parts)
        inner = sorted({c for c in cuts if np.isfinite(c)})
        if inner:  # by bisection: there are more cuts the larger a group is, so counting those below would cost its square
            ends = Bucketizer(splits=[-np.inf, *inner, np.inf], inputCol="_v", outputCol=CHUNK, handleInvalid="keep")
            long = ends.transform(long).withColumn(CHUNK, F.when(F.col("_v").isNull(), 0).otherwise(F.col(CHUNK)).cast("long"))
        else:
            long = long.withColumn(CHUNK, F.lit(0).cast("long"))
        mk = F.struct("_v", "_id")
        long = chunk_carry(
            long, keys, {"_hi": F.max(mk), "_lo": F.min(mk), "_c": F.count(F.lit(1))},
            {"_left": before(keys, F.max("_hi")).getField("_v"),
             "_right": after(keys, F.min("_lo")).getField("_v"),
             "_spread": (F.max("_hi").over(Window.partitionBy(*keys)).getField("_v")
                         - F.min("_lo").over(Window.partitionBy(*keys)).getField("_v")),
             "_size": F.sum("_c").over(Window.partitionBy(*keys))})
        w = Window.partitionBy(*keys, CHUNK).orderBy("_v", "_id")
        long = (long.withColumn("_p", F.coalesce(F.lag("_v").over(w), F.col("_left")))
                .withColumn("_n", F.coalesce(F.lead("_v").over(w), F.col("_right"))))
    inf = F.lit(float("inf"))
    part = (F.when(F.col("_p").isNull() | F.col("_n").isNull() | (F.col("_size") <= 2), inf)
            .when(F.col("_spread") > 0, (F.col("_n") - F.col("_p")) / F.col("_spread")).otherwise(0.0))
    dist = long.groupBy(*group, F.col("_id").alias(id_column)).agg(F.sum(part).alias("crowding"))
    return front.join(dist, [*group, id_column])


def select_best(ranked: DataFrame, n: int, id_column: str) -> DataFrame:
    return ranked.orderBy(F.col("rank").asc_nulls_last(), F.desc("crowding"), id_column).limit(n)


def first_dominating(points: np.ndarray, front: np.ndarray, width: int = 64) -> np.ndarray:
    """For each point the first row of `front` that dominates it, or -1; the front is walked in blocks of `width`."""
    out = np.full(len(points), -1, dtype=np.int64)
    live = np.arange(len(points))
    for start in range(0, len(front), width):
        block = front[start:start + width]
        p = points[live, None, :]
        good = (block[None] <= p).all(2) & (block[None] < p).any(2)
        hit = good.any(1)
        out[live[hit]] = start + good[hit].argmax(1)
        live = live[~hit]
        if not len(live):
            break
    return out


def improvement_gap(current: DataFrame, front: DataFrame,
                    objectives: Sequence[tuple[str, str, float, float, float]], id_column: str,
                    current_id: str, threshold: float = 0.05, slice_rows: int = SLICE,
                    cell_rows: int = CELL) -> DataFrame:
    """Per current point the dominating front point with the largest weighted gain.

    `objectives`: (column, direction, weight, range low, range high).  Ties go to the smaller front id.  The gain over
    a dominating point is the difference of two weighted sums, so the best one has the smallest sum: a group sorts its
    front points by it, and the first that dominates wins.  Current points and front lie in the cells of one
    grid, and cells meet only where the best gain can come from.
    """
    ensure_checkpoint_dir(current.sparkSession)
    plain = [(c, d) for c, d, *_ in objectives]
    names = list(signed(plain))
    weights = np.array([w / max(abs(hi - lo), 1e-6) for _, _, w, lo, hi in objectives])
    cur = current.withColumns(signed(plain))
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    ask = cur.filter(whole).select(F.col(current_id).cast("long").alias("_id"), *names).checkpoint()
    pts = front.withColumns(signed(plain)).filter(whole).select(
        F.col(id_column).cast("long").alias("_fid"), *names).checkpoint()
    cuts = grid_cuts(pts, names, pts.count(), cell_rows)
    ask, pts = with_cells(ask, names, cuts), with_cells(pts, names, cuts)
    asked, held = cell_boxes(ask, names), cell_boxes(pts, names)
    pairs = gaining_cells(asked, held, names, weights)
    mine, other = _meet(ask, pts, pairs, _parts(asked, slice_rows), _parts(held, slice_rows), ["_id", *names], ["_fid", *names])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f, ids = right[names].to_numpy(float), right["_fid"].to_numpy("int64")
        order = np.lexsort((ids, f @ weights))
        p = left[names].to_numpy(float)
        at = first_dominating(p, f[order])
        hit = at >= 0
        j = order[at[hit]]
        gain = (np.maximum(p[hit] - f[j], 0) * weights).sum(1)
        return pd.DataFrame({"_id": left["_id"].to_numpy("int64")[hit], "best_id": ids[j], "distance": gain})

    found = (mine.cogroup(other).applyInPandas(best, "_id long, best_id long, distance double")
             .groupBy("_id").agg(F.max_by(F.struct("best_id", "distance"),
                                          F.struct(F.col("distance"), -F.col("best_id"))).alias("b"))
             .select(F.col("_id").alias("_cid"), "b.best_id", "b.distance")
             .filter((F.col("distance") > 0) & (F.col("distance") >= threshold)))
    fp = front.select(F.col(id_column).cast("long").alias("best_id"), *[F.col(c).alias(f"best_{c}") for c, _ in plain])
    d = (cur.join(found, F.col(current_id).cast("long") == F.col("_cid")).join(fp, "best_id"))
    moves = [((F.col(f"best_{c}") - F.col(c)) if k == "maximize" else (F.col(c) - F.col(f"best_{c}")))
             .alias(f"gain_{c}") for c, k in plain]
    return d.select(current_id, "best_id", "distance", *moves)


def compare_points(front: DataFrame, nominal: DataFrame, current: DataFrame) -> DataFrame:
    """Front, nominal and current rows in one table with a `kind` column."""
    out = None
    for kind, df in (("front", front), ("nominal", nominal), ("current", current)):
        d = df.withColumn("kind", F.lit(kind))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def fill_from_current(requests: DataFrame, current: DataFrame, columns: Sequence[str], order: Sequence[Column | str],
                      keys: Sequence[str] = ()) -> DataFrame:
    """Missing inputs of a what-if request come from the row that `order` puts last, one for each of `keys`."""
    row = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    c = current.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[x].alias(f"_c_{x}") for x in columns])
    d = requests.join(c, list(keys), "left") if keys else requests.join(F.broadcast(c))
    return d.withColumns({x: F.coalesce(F.col(x), F.col(f"_c_{x}")) for x in columns}).drop(
        *[f"_c_{x}" for x in columns])


def envelope(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[a for c in columns for a in (
        F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])
