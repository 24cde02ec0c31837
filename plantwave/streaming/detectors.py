"""Keyed incremental detectors: a state per (asset, tag), kept by buckets of them and updated per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.recurrences import Cooldown, Cusum, Ewma
from ..operators.scale import checked_broadcast
from ..session import ROCKSDB
from .buckets import PIECE_DDL, bucket, pack, unpack

OUT_DDL = ("asset STRING, tag STRING, ts TIMESTAMP, detector STRING, value DOUBLE, lim DOUBLE, side STRING, "
           "deviation DOUBLE")
#: In place of a detector, on rows whose value counts readings of a micro-batch that no detector judged.
LATE, UNKNOWN = "Dropped.Late", "Dropped.NoBaseline"
FIRED = ["fired_shewhart", "fired_ewma", "fired_cusum", "fired_frozen", "fired_trend"]
CHART_STATE = pa.schema(
    [("asset", pa.string()), ("tag", pa.string()), ("last_us", pa.int64()), *[(c, pa.float64()) for c in ("ewma", "up", "down", *FIRED)],
     ("ring", pa.list_(pa.float64())), ("dropped", pa.int64()), ("seen", pa.int64()), ("trend_us", pa.list_(pa.int64())),
     ("trend", pa.list_(pa.float64()))])
STALE_STATE = pa.schema([("asset", pa.string()), ("tag", pa.string()), ("last_us", pa.int64()), ("value", pa.float64()),
                         ("changed_us", pa.int64())])
#: Seconds of event time after its last reading that a series' state stays; readings later than that are too late.
TTL_S = 30 * 86_400.0


def trend_of_new(us: np.ndarray, x: np.ndarray, new: int, seen: int, rows: int, smooth_rows: int, step: int):
    """(place, smooth, slope per minute, r2) of the rows among the last `new` at which a trend is due.

    `us` and `x` are the kept and the new readings in order, `seen` the readings before the new ones.  Means are sums of
    their own readings and fits are centred on their own window: differences of running sums lose the digits that decide
    at a limit, the more the longer the series has been kept.
    """
    at = np.arange(1, len(x) + 1)
    y = np.zeros(len(x))
    for back in range(min(smooth_rows, len(x)) - 1, -1, -1):  # oldest first
        y[back:] += x[:len(x) - back]
    y /= np.minimum(at, smooth_rows)
    number = seen - (len(x) - new) + at  # of each reading, from 1
    due = np.flatnonzero((at > len(x) - new) & (number >= rows) & ((number - rows) % step == 0))
    ctt, cty, cyy = np.empty(len(due)), np.empty(len(due)), np.empty(len(due))
    width = max(1, 1_000_000 // rows)
    for first in range(0, len(due), width):
        part = slice(first, first + width)
        window = due[part, None] + np.arange(1 - rows, 1)
        t = (us[window] - us[window[:, :1]]) / 60e6
        t, v = t - t.mean(1, keepdims=True), y[window] - y[window].mean(1, keepdims=True)
        ctt[part], cty[part], cyy[part] = (t * t).sum(1), (t * v).sum(1), (v * v).sum(1)
    level = (ctt < 1e-12) | (rows < 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(level, 0.0, cty / ctt)
        r2 = np.where(level | (cyy < 1e-12), 0.0, np.clip(cty * cty / (ctt * cyy), 0, 1))
    return due, y[due], slope, r2


class Series(StatefulProcessor):
    """State of many (asset, tag) series in one bucket, a row each.

    A series' row ends when event time, which lags by its time to live, passes its last reading: a timer waits for the
    first row of the bucket to end.
    """

    schema: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at_ms LONG")
        self.state = handle.getListState("series", PIECE_DDL)

    def _held(self) -> pd.DataFrame:
        return unpack(self.state.get(), self.schema)

    def _keep(self, held: pd.DataFrame) -> None:
        old = self.until.get()
        at = int(held["last_us"].min()) // 1000 + 1 if len(held) else None
        if old is not None and old[0] != at:
            self.handle.deleteTimer(old[0])
        if at is None:
            self.state.clear()
            self.until.clear()
            return
        self.state.put(pack(held, self.schema))
        if old is None or old[0] != at:
            self.handle.registerTimer(at)
            self.until.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, due = self.until.get(), expiredTimerInfo.getExpiryTimeInMs()
        if at is not None and at[0] == due:
            held = self._held()
            ends = held["last_us"].to_numpy() // 1000 + 1
            self.until.clear()
            self._keep(held[(ends > due) & (ends >= timerValues.getCurrentWatermarkInMs())])
        return iter(())

    def close(self) -> None:
        pass


def by_series(pdf: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of a series together and in order, and the first row of each."""
    codes = pd.factorize(pd.MultiIndex.from_arrays([pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in ("asset", "tag")]))[0]
    pdf = pdf.assign(_s=codes).sort_values(["_s", *order], kind="stable", ignore_index=True)
    return pdf, np.flatnonzero(np.diff(pdf["_s"].to_numpy(), prepend=-1))


def _none(v):
    return None if v is None or v != v else [float(v)]


def _first(v):
    return np.nan if v is None else float(v[0])


class ChartProcessor(Series):
    """Shewhart, EWMA, CUSUM, frozen and trend checks with cooldown.

    Rows of a batch are put in time order first, equal times by value; rows older than the last one
    seen are dropped and put out as a count, as are those of a series without a baseline.  Each input row carries
    its series' parameters.  A series that has been silent for the time to live starts anew.
    """

    schema = CHART_STATE

    def __init__(self, frozen_rows: int = 20, min_std: float = 1e-4, lam: float = 0.2,
                 trend: tuple[int, int, int] = (60, 5, 1), min_r2: float = 0.25, horizon_minutes: float = 240,
                 trend_cooldown_s: float = 1800):
        self.frozen_rows, self.min_std, self.lam = frozen_rows, min_std, lam
        self.trend, self.min_r2, self.horizon, self.trend_cooldown_s = trend, min_r2, horizon_minutes, trend_cooldown_s

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).dropna(subset=["value"])
        if not len(pdf):
            return
        unknown = ~pdf["has_baseline"].to_numpy(bool)
        out = [self._counts(pdf[unknown], UNKNOWN)] if unknown.any() else []
        if not unknown.all():
            self._judge(pdf[~unknown], out)
        if out:
            yield pd.concat(out)

    def _judge(self, pdf: pd.DataFrame, out: list[pd.DataFrame]) -> None:
        pdf, starts = by_series(pdf, ["ts", "value"])
        held = self._held()
        place = {k: i for i, k in enumerate(zip(held["asset"], held["tag"]))}
        at = [place.get(k, -1) for k in zip(pdf["asset"].to_numpy()[starts], pdf["tag"].to_numpy()[starts])]
        # the state before of each series in this batch, blank rows for new ones
        before = held.reindex(at).reset_index(drop=True)
        before[["asset", "tag"]] = pdf.loc[starts, ["asset", "tag"]].to_numpy()
        us = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
        floor = np.array([held["last_us"].iat[i] if i >= 0 else -(1 << 62) for i in at], dtype="int64")
        fresh = us >= floor[number]
        if not fresh.all():
            out.append(self._counts(pdf[~fresh], LATE))
            before["dropped"] = before["dropped"].fillna(0).to_numpy() + np.bincount(number[~fresh], minlength=len(starts))
        before["dropped"] = before["dropped"].fillna(0)
        before["seen"] = before["seen"].fillna(0)
        after = before.copy()
        after["last_us"] = floor
        if fresh.any():
            d = pdf[fresh].assign(_us=us[fresh], _n=number[fresh]).reset_index(drop=True)
            self._charts(out, d, before, after)
        rest = np.ones(len(held), bool)
        rest[[i for i in at if i >= 0]] = False
        self._keep(pd.concat([held[rest], after]) if rest.any() else after)

    def _charts(self, out: list[pd.DataFrame], d: pd.DataFrame, before: pd.DataFrame, after: pd.DataFrame) -> None:
        """Judges the fresh rows `d` of all series; `_n` is the series' row in `before` and `after`."""
        number, x, us = d["_n"].to_numpy(), d["value"].to_numpy(float), d["_us"].to_numpy()
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        ends, own = np.append(starts[1:], len(d)), number[starts]
        mean, sigma = d["mean"].to_numpy(float), d["sigma"].to_numpy(float)
        new = {c: after[c].to_numpy(object) for c in ("ewma", "up", "down", *FIRED, "ring", "seen", "trend_us", "trend", "last_us")}
        new["last_us"][own] = us[ends - 1]

        def emit(name, rows, value, upper, lower, scale, cooldown_s, fired):
            self._emit(out, d, name, rows, value, upper, lower, scale, cooldown_s, new[fired])

        emit("SPC.Shewhart", np.flatnonzero((x > d["ucl"]) | (x < d["lcl"])), x, d["ucl"], d["lcl"], sigma, 600, "fired_shewhart")

        # one pass over all series, each begun with its state or its mean
        entry = before["ewma"].to_numpy(float)[own]
        entry = np.where(np.isnan(entry), mean[starts], entry)
        code = np.insert(number, starts, own)
        first = starts + np.arange(len(starts))
        e = pd.Series(np.insert(x, starts, entry)).groupby(code).ewm(alpha=self.lam, adjust=False).mean().to_numpy()
        e = np.delete(e, first)
        new["ewma"][own] = e[ends - 1]
        emit("SPC.EWMA", np.flatnonzero((e > d["ewma_ucl"]) | (e < d["ewma_lcl"])), e, d["ewma_ucl"], d["ewma_lcl"],
             d["ewma_sigma"], 600, "fired_ewma")

        found, ups, downs = [], before["up"].to_numpy(float), before["down"].to_numpy(float)
        for a, b, i in zip(starts.tolist(), ends.tolist(), own.tolist()):
            state = None if np.isnan(ups[i]) else [float(ups[i]), float(downs[i])]
            rows, _, (new["up"][i], new["down"][i]) = Cusum().emit({"value": x[a:b], "mean": mean[a:a + 1], "sigma": sigma[a:a + 1]}, state)
            if len(rows):
                found.append(rows + a)
        emit("Regime.CUSUM", np.concatenate(found) if found else np.empty(0, int), x, mean, mean, sigma, 1800, "fired_cusum")

        # readings behind those kept of each series: `frozen_rows` before a row make it stuck
        n, rings = self.frozen_rows, before["ring"].to_numpy(object)
        kept = [np.asarray(r, float) if isinstance(r, (list, np.ndarray)) else np.empty(0) for r in rings[own]]
        size = np.array([len(k) for k in kept])
        series = np.insert(x, np.repeat(starts, size), np.concatenate(kept))
        code = np.insert(number, np.repeat(starts, size), np.repeat(own, size))
        is_new = np.insert(np.ones(len(x), bool), np.repeat(starts, size), False)
        std = pd.Series(series).groupby(code).rolling(n).std(ddof=0).to_numpy()
        opens = np.diff(code, prepend=-1) != 0
        std, stuck = (np.where(opens, np.nan, np.roll(v, 1))[is_new] for v in (std, series))
        limit = np.full(len(x), self.min_std)
        emit("FrozenSensor", np.flatnonzero(std < self.min_std), stuck, limit, limit, sigma, 1800, "fired_frozen")
        closes = np.append(np.flatnonzero(opens)[1:], len(series))
        opens = np.flatnonzero(opens)
        for i, a, b in zip(own.tolist(), opens.tolist(), closes.tolist()):
            new["ring"][i] = series[max(a, b - n):b]

        limited = d["has_limits"].to_numpy(bool)
        for a, b, i in zip(starts.tolist(), ends.tolist(), own.tolist()):
            if limited[a]:
                self._trend(out, d.iloc[a:b], x[a:b], i, new)
            new["seen"][i] = int(new["seen"][i]) + b - a
        for c, v in new.items():
            after[c] = v

    def _trend(self, out, pdf, x, i, new):
        """Lines that reach a limit within the horizon; keeps the readings that the next rows still need."""
        rows, smooth_rows, step = self.trend
        p, kept_us, kept_x = pdf.iloc[0], new["trend_us"][i], new["trend"][i]
        had = isinstance(kept_us, (list, np.ndarray))
        us = np.concatenate([np.asarray(kept_us if had else [], "int64"), pdf["_us"].to_numpy("int64")])
        values = np.concatenate([np.asarray(kept_x if had else [], float), x])
        due, y, slope, r2 = trend_of_new(us, values, len(x), int(new["seen"][i]), rows, smooth_rows, step)
        low, high = float(p["low"]), float(p["high"])  # NaN where there is none
        breach = np.where((slope > 1e-9) & (y < high), high, np.where((slope < -1e-9) & (y > low), low, np.nan))
        with np.errstate(divide="ignore", invalid="ignore"):
            minutes = (breach - y) / slope
        good = (r2 >= self.min_r2) & (minutes >= 0) & (minutes <= self.horizon)
        n = rows + smooth_rows
        new["trend_us"][i], new["trend"][i] = us[-n:], values[-n:]
        if not good.any():
            return
        hit = pdf.iloc[due[good] - (len(values) - len(x))].assign(_y=y[good], _lim=breach[good], _up=slope[good] > 0)
        keep, _, fired = Cooldown().emit({"_us": hit["_us"].to_numpy("int64"),
                                          "cooldown_s": np.full(len(hit), float(self.trend_cooldown_s))}, _none(new["fired_trend"][i]))
        new["fired_trend"][i] = _first(fired)
        hit = hit.iloc[keep]
        if len(hit):
            out.append(pd.DataFrame({
                "asset": p["asset"], "tag": p["tag"], "ts": hit["ts"].to_numpy(), "detector": "Trend.Projection",
                "value": hit["_y"].to_numpy(float), "lim": hit["_lim"].to_numpy(float),
                "side": np.where(hit["_up"], "above", "below").astype(object), "deviation": np.nan}))

    @staticmethod
    def _counts(rows, name):
        d, starts = by_series(rows, ["ts"])
        ends = np.append(starts[1:], len(d))
        return pd.DataFrame({"asset": d["asset"].to_numpy()[starts], "tag": d["tag"].to_numpy()[starts], "ts": d["ts"].to_numpy()[ends - 1],
                             "detector": name, "value": (ends - starts).astype(float), "lim": np.nan, "side": None, "deviation": np.nan})

    @staticmethod
    def _emit(out, d, name, rows, value, upper, lower, sigma, cooldown_s, fired):
        """Thins the hit rows of each series by its cooldown; `fired` holds the time it last fired."""
        if not len(rows):
            return
        number, us, cooldown = d["_n"].to_numpy()[rows], d["_us"].to_numpy()[rows], np.array([float(cooldown_s)])
        starts, kept = np.flatnonzero(np.diff(number, prepend=-1)), []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(rows)).tolist()):
            keep, _, last = Cooldown().emit({"_us": us[a:b], "cooldown_s": cooldown}, _none(fired[number[a]]))
            fired[number[a]] = _first(last)
            kept.append(keep + a)
        at = rows[np.concatenate(kept)]
        if not len(at):
            return
        v, up, down = (np.asarray(c, float)[at] for c in (value, upper, lower))
        out.append(pd.DataFrame({
            "asset": d["asset"].to_numpy()[at], "tag": d["tag"].to_numpy()[at], "ts": d["ts"].to_numpy()[at], "detector": name,
            "value": v, "lim": np.where(v > up, up, down), "side": np.where(v > up, "above", "below").astype(object),
            "deviation": np.abs(v - d["mean"].to_numpy(float)[at]) / np.asarray(sigma, float)[at]}))


class StaleProcessor(Series):
    """Reading quality with the last change kept per (asset, tag), until a series has gone silent."""

    schema = STALE_STATE

    def __init__(self, stale_s: float = 10.0):
        self.stale_us = int(stale_s * 1e6)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf, _ = by_series(pd.concat(list(rows)), ["ts"])
        every = pdf["value"].to_numpy(float)
        some = np.flatnonzero(~np.isnan(every))
        flags = np.full(len(pdf), 3, dtype="int32")
        if len(some):
            d, v = pdf.iloc[some], every[some]
            t = d["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            number = d["_s"].to_numpy()
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            ends = np.append(starts[1:], len(v))
            keys = list(zip(d["asset"].to_numpy()[starts], d["tag"].to_numpy()[starts]))
            held = self._held()
            place = {k: i for i, k in enumerate(zip(held["asset"], held["tag"]))}
            at = np.array([place.get(k, -1) for k in keys])
            old = at >= 0
            before = np.roll(v, 1)
            before[starts] = np.nan
            before[starts[old]] = held["value"].to_numpy()[at[old]]
            moved = ~(np.abs(v - before) < 1e-9)
            # the time of the last change at each reading; before the first one here it is the one in the state
            first = np.repeat(starts, ends - starts)
            change = np.maximum.accumulate(np.where(moved, np.arange(len(v)), first))
            since = np.zeros(len(starts), dtype="int64")
            since[old] = held["changed_us"].to_numpy()[at[old]]
            changed = np.where(moved[change], t[change], np.repeat(since, ends - starts))
            stale = ~moved & (t - changed > self.stale_us)
            low, high = d["min_range"].to_numpy(float), d["max_range"].to_numpy(float)
            flags[some] = np.where((v < low) | (v > high), 1, np.where(stale, 2, 0))
            last = t[ends - 1]
            last[old] = np.maximum(last[old], held["last_us"].to_numpy()[at[old]])
            after = pd.DataFrame({"asset": [k[0] for k in keys], "tag": [k[1] for k in keys], "last_us": last,
                                  "value": v[ends - 1], "changed_us": changed[ends - 1]})
            rest = np.ones(len(held), bool)
            rest[at[old]] = False
            self._keep(pd.concat([held[rest], after]) if rest.any() else after)
        yield pd.DataFrame({"asset": pdf["asset"].to_numpy(), "tag": pdf["tag"].to_numpy(),
                            "ts": pdf["ts"].to_numpy(), "value": every, "quality": flags})


def _stateful(stream: DataFrame, processor: StatefulProcessor, ddl: str, ttl_s: float) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    d = stream.withWatermark("ts", f"{int(ttl_s)} seconds").withColumn("bucket", bucket("asset", "tag"))
    return d.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=ddl, outputMode="Append", timeMode="EventTime")


def chart_stream(readings: DataFrame, baseline: DataFrame, frozen_rows: int = 20, limits: DataFrame | None = None,
                 ttl_s: float = TTL_S, **settings) -> DataFrame:
    """Alerts of a stream of readings against static per-(asset, tag) limits, and counts of what was not judged.

    `limits` (tag, low, high) turns trend projections on for the tags it declares; `settings` go to `ChartProcessor`.

    Rows of detector `LATE` and `UNKNOWN` hold such counts, one per series and micro-batch at most; their sums
    and the judged readings add up to all readings that have a value.
    """
    params = baseline.select("asset", "tag", "mean", "sigma", "ucl", "lcl", "ewma_sigma", "ewma_ucl", "ewma_lcl")
    d = readings.select("asset", "tag", "ts", "value").join(params.withColumn("has_baseline", F.lit(True)), ["asset", "tag"], "left")
    d = d.withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False)))
    if limits is None:
        d = d.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "has_limits": F.lit(False)})
    else:
        either = F.col("low").isNotNull() | F.col("high").isNotNull()
        tags = limits.select("tag", F.col("low").cast("double"), F.col("high").cast("double")).filter(either)
        d = d.join(checked_broadcast(tags.withColumn("has_limits", F.lit(True))), "tag", "left").withColumn(
            "has_limits", F.coalesce("has_limits", F.lit(False)))
    return _stateful(d, ChartProcessor(frozen_rows, **settings), OUT_DDL, ttl_s)


def without_baseline(readings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Readings that `chart_stream` only counts, as their series has no baseline: to be stored."""
    return readings.join(baseline.select("asset", "tag"), ["asset", "tag"], "left_anti")


def quality_stream(readings: DataFrame, tag_map: DataFrame, stale_s: float = 10.0, ttl_s: float = TTL_S) -> DataFrame:
    d = readings.select("asset", "tag", "ts", "value").join(
        checked_broadcast(tag_map.select("tag", "min_range", "max_range")), "tag")
    return _stateful(d, StaleProcessor(stale_s), "asset STRING, tag STRING, ts TIMESTAMP, value DOUBLE, quality INT", ttl_s)
