"""Sequential scans that resets or feedback keep out of window functions.

EWMA, CUSUM with reset and greedy cooldown thinning are recurrences.  Each one is
written as a small class with three parts, so a series can be cut into chunks and
still give the sequential answer:

* ``emit(c, state)``     – run the chunk from a known entry state,
* ``summarise(c)``       – the chunk's effect on *any* entry state, as numbers,
* ``advance(state, s)``  – apply such a summary.

`c` maps column names to the chunk's arrays in time order.  :func:`scan` shuffles and
sorts by (series, chunk) with a row-number window, folds the summaries per series (a
row per chunk) and runs every chunk with its own entry state in parallel.  Groups are
handed to Python many at a time, so short series cost no call each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import CHUNK, with_chunk


class Ewma:
    """e ← λx + (1−λ)e, starting from the series mean in column `mean`."""

    out_ddl = "ewma DOUBLE"

    def __init__(self, lam: float = 0.2, value: str = "value"):
        self.lam, self.value = lam, value
        self.needs = [value, "mean"]

    def _average(self, x: np.ndarray, start: float) -> np.ndarray:
        full = np.concatenate([[start], x])
        return pd.Series(full).ewm(alpha=self.lam, adjust=False).mean().to_numpy()[1:]

    def emit(self, c, state):
        e = self._average(c[self.value], c["mean"][0] if state is None else state[0])
        return np.arange(len(e)), {"ewma": e}, [float(e[-1])]

    def summarise(self, c):
        x = c[self.value]
        return [(1.0 - self.lam) ** len(x), float(self._average(x, 0.0)[-1]), float(c["mean"][0])]

    def advance(self, state, s):
        start = s[2] if state is None else state[0]
        return [s[0] * start + s[1]]


class Cusum:
    """Two-sided sum of deviations; both sides restart at zero after a trigger.

    Needs columns `mean` and `sigma`.  Only trigger rows are returned.
    """

    out_ddl = "direction STRING, cusum DOUBLE"

    def __init__(self, k_sigma: float = 0.5, h_sigma: float = 5.0, value: str = "value"):
        self.k_sigma, self.h_sigma, self.value = k_sigma, h_sigma, value
        self.needs = [value, "mean", "sigma"]

    def _steps(self, c):
        sigma = float(c["sigma"][0])
        d = c[self.value] - float(c["mean"][0])
        k = self.k_sigma * sigma
        return d - k, -d - k, self.h_sigma * sigma

    @staticmethod
    def _run(up, down, h, i, a, b):
        """From state (a, b) before row i: (trigger row or n, side, sum, a, b)."""
        n, width = len(up), 32
        while i < n:
            stop = min(n, i + width)
            p, q = np.cumsum(up[i:stop]), np.cumsum(down[i:stop])
            sp = p - np.minimum(np.minimum.accumulate(p), -a)
            sq = q - np.minimum(np.minimum.accumulate(q), -b)
            hit = (sp > h) | (sq > h)
            if hit.any():
                j = int(hit.argmax())
                side = 1 if sp[j] > h else -1
                return i + j, side, float(sp[j] if side > 0 else sq[j]), 0.0, 0.0
            a, b, i = float(sp[-1]), float(sq[-1]), stop
            width = min(width * 2, 8192)
        return n, 0, 0.0, a, b

    def emit(self, c, state):
        up, down, h = self._steps(c)
        a, b = (0.0, 0.0) if state is None else (state[0], state[1])
        rows, sides, sums, i = [], [], [], 0
        while True:
            j, side, s, a, b = self._run(up, down, h, i, a, b)
            if side == 0:
                break
            rows.append(j)
            sides.append("upward" if side > 0 else "downward")
            sums.append(s)
            i = j + 1
        extra = {"direction": np.array(sides, dtype=object), "cusum": np.array(sums, dtype=float)}
        return np.array(rows, dtype=int), extra, [a, b]

    def summarise(self, c):
        """Layout: P, Q, S+(0), S−(0), h, first trigger or −1, its exit (2), then two
        lists of (rise, row, exit+, exit−) for rows an entry state could trigger at."""
        up, down, h = self._steps(c)
        n = len(up)
        t0, side0, _, a0, b0 = self._run(up, down, h, 0, 0.0, 0.0)
        memo: dict[int, tuple[float, float]] = {}

        def exit_after(row: int) -> tuple[float, float]:
            path, i = [], row
            while i not in memo:
                path.append(i)
                j, side, _, a, b = self._run(up, down, h, i + 1, 0.0, 0.0)
                if side == 0:
                    memo[i] = (a, b)
                    break
                i = j
            for p in path:
                memo[p] = memo[i]
            return memo[row]

        limit = t0 if side0 else n
        out = [float(up.sum()), float(down.sum()), a0, b0, h]
        out += [float(t0), *exit_after(t0)] if side0 else [-1.0, 0.0, 0.0]
        for steps in (up[:limit], down[:limit]):
            rise = np.cumsum(steps)
            top = np.maximum.accumulate(np.concatenate([[0.0], rise]))[:-1]
            records = np.flatnonzero(rise > top)
            out.append(float(len(records)))
            for r in records:
                out += [float(rise[r]), float(r), *exit_after(int(r))]
        return out

    def advance(self, state, s):
        a, b = (0.0, 0.0) if state is None else (state[0], state[1])
        p, q, sp, sq, h, t0, ea, eb = s[:8]
        best = (t0, ea, eb) if t0 >= 0 else None
        pos = 8
        for entry in (a, b):
            count = int(s[pos])
            block = np.asarray(s[pos + 1: pos + 1 + 4 * count]).reshape(count, 4)
            pos += 1 + 4 * count
            k = int(np.searchsorted(block[:, 0], h - entry, side="right"))
            if k < count and (best is None or block[k, 1] < best[0]):
                best = (block[k, 1], block[k, 2], block[k, 3])
        if best is not None:
            return [float(best[1]), float(best[2])]
        return [max(sp, a + p), max(sq, b + q)]


class Cooldown:
    """Greedy thinning: keep a row if the last kept one is far enough back.

    `strict` keeps rows more than `cooldown_s` later, otherwise at least that much.
    The cooldown is read from column `cooldown_s` (constant per series).
    """

    out_ddl = ""

    def __init__(self, strict: bool = True, order: str = "_us"):
        self.side = "right" if strict else "left"
        self.order = order
        self.needs = [order, "cooldown_s"]

    def _times(self, c):
        return c[self.order].astype("int64"), int(round(float(c["cooldown_s"][0]) * 1e6))

    def emit(self, c, state):
        t, cd = self._times(c)
        nxt = np.searchsorted(t, t + cd, side=self.side)
        i = 0 if state is None else int(np.searchsorted(t, int(state[0]) + cd, side=self.side))
        keep = []
        while i < len(t):
            keep.append(i)
            i = max(int(nxt[i]), i + 1)
        last = state if not keep else [float(t[keep[-1]])]
        return np.array(keep, dtype=int), {}, last

    def summarise(self, c):
        """[cooldown, then pairs (last candidate of a run, last kept row it leads to)]."""
        t, cd = self._times(c)
        n = len(t)
        jump = np.maximum(np.searchsorted(t, t + cd, side=self.side), np.arange(n) + 1)
        last = np.arange(n)
        while (jump < n).any():
            live = jump < n
            src = np.where(live, jump, 0)
            last = np.where(live, last[src], last)
            jump = np.where(live, jump[src], jump)
        exits = t[last]
        run_end = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
        return [float(cd)] + [float(v) for i in run_end for v in (t[i], exits[i])]

    def advance(self, state, s):
        pairs = np.asarray(s[1:]).reshape(-1, 2)
        i = 0 if state is None else int(np.searchsorted(pairs[:, 0], state[0] + s[0], side=self.side))
        return state if i >= len(pairs) else [float(pairs[i, 1])]


ROW = "_row"


def whole_groups(batches):
    """Batches of complete groups with their start rows, from sorted Arrow batches.

    Column ROW is 1 on the first row of each group; an open group is held back until
    its end is seen, so memory holds one batch and one group.
    """
    held: list[pd.DataFrame] = []
    for pdf in batches:
        starts = np.flatnonzero(pdf[ROW].to_numpy() == 1)
        if not len(starts):
            held.append(pdf)
            continue
        cut = int(starts[-1])
        if held or cut:
            done = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            yield done, np.flatnonzero(done[ROW].to_numpy() == 1)
        held = [pdf.iloc[cut:]]
    if held:
        done = pd.concat(held, ignore_index=True)
        if len(done):
            yield done, np.flatnonzero(done[ROW].to_numpy() == 1)


def grouped_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Groups contiguous and in order inside each partition, numbered by ROW.

    The window gives the shuffle and the sort; a join on the same keys before it is
    reused instead of shuffling again.
    """
    return df.withColumn(ROW, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def scan(df: DataFrame, recurrence, keys: Sequence[str], order: Sequence[str] = ("ts",),
         ts: str = "ts", seconds: int | None = None) -> DataFrame:
    """Run a recurrence over every series of `df` and return its output rows."""
    order, keys = list(order), list(keys)
    extra = T.StructType.fromDDL(recurrence.out_ddl) if recurrence.out_ddl else T.StructType([])
    out_schema = T.StructType([f for f in df.schema.fields if f.name != CHUNK] + extra.fields)
    names, extra_names, needs = out_schema.names, extra.names, list(recurrence.needs)

    def run(batches):
        for pdf, starts in whole_groups(batches):
            cols = {c: pdf[c].to_numpy() for c in needs}
            entries = pdf["entry"].to_numpy() if "entry" in pdf.columns else None
            rows, extras = [], {c: [] for c in extra_names}
            for a, b in zip(starts, np.append(starts[1:], len(pdf))):
                entry = None if entries is None or entries[a] is None else list(entries[a])
                r, e, _ = recurrence.emit({c: v[a:b] for c, v in cols.items()}, entry)
                rows.append(r + a)
                for c in extra_names:
                    extras[c].append(e[c])
            out = pdf.iloc[np.concatenate(rows)]
            yield out.assign(**{c: np.concatenate(v) for c, v in extras.items()})[names]

    if not seconds:
        return grouped_rows(df, keys, order).mapInPandas(run, out_schema)

    chunked = with_chunk(df, ts, seconds)
    head = T.StructType([*[chunked.schema[k] for k in keys], T.StructField(CHUNK, T.LongType())])

    def summarise(batches):
        for pdf, starts in whole_groups(batches):
            cols = {c: pdf[c].to_numpy() for c in needs}
            sums = [recurrence.summarise({c: v[a:b] for c, v in cols.items()})
                    for a, b in zip(starts, np.append(starts[1:], len(pdf)))]
            yield pdf.iloc[starts][head.names].assign(summary=sums)

    def fold(batches):
        state = None
        for pdf in batches:
            entries = []
            for first, s in zip(pdf[ROW].to_numpy() == 1, pdf["summary"].to_numpy()):
                state = None if first else state
                entries.append(state)
                state = recurrence.advance(state, list(s))
            yield pdf[head.names].assign(entry=entries)

    doubles = T.ArrayType(T.DoubleType())
    sums = grouped_rows(chunked, [*keys, CHUNK], order).mapInPandas(
        summarise, T.StructType([*head, T.StructField("summary", doubles)]))
    entries = grouped_rows(sums, keys, [CHUNK]).mapInPandas(
        fold, T.StructType([*head, T.StructField("entry", doubles)]))
    return grouped_rows(chunked.join(entries, [*keys, CHUNK]), [*keys, CHUNK], order).mapInPandas(run, out_schema)


def thin(df: DataFrame, keys: Sequence[str], cooldown_s: float | None = None, strict: bool = True,
         ts: str = "ts", tie: Sequence[str] = (), seconds: int | None = None) -> DataFrame:
    """Keep the first row of each series and then each row that has cooled down.

    Pass `cooldown_s`, or give the frame a `cooldown_s` column of its own.  Chunks are made
    a few cooldowns wide, as a shorter chunk's summary would list every row.
    """
    own = cooldown_s is None
    if seconds and not own and CHUNK not in df.columns:
        seconds = max(seconds, int(4 * cooldown_s))
    d = df if own else df.withColumn("cooldown_s", F.lit(float(cooldown_s)))
    d = d.withColumn("_us", F.unix_micros(F.col(ts)))
    out = scan(d, Cooldown(strict), keys, ["_us", *tie], ts, seconds).drop("_us")
    return out if own else out.drop("cooldown_s")
