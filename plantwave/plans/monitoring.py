"""The whole batch run: readings → alerts → sessions → recommendations → outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SERIES
from ..operators import charts, decisions as dec, pca, rolling
from ..operators.alerts import after_warmup, run_starts, union_alerts
from ..operators.rules import PILOT_RULES, Rule, recommend, session_context
from ..operators.scale import checked_broadcast, chunk_seconds_for
from ..operators.sessions import sessionise
from ..session import ensure_checkpoint_dir
from ..sources.samples import to_wide

# An extra detector turns readings into alerts; its failures propagate.
Detector = Callable[[DataFrame], DataFrame]


@dataclass
class Settings:
    """Parameters of one monitoring run."""

    period_s: float = 60.0
    warmup_minutes: float = 15.0
    gap_minutes: float = 30.0
    training_fraction: float = 0.25
    baseline_scenario: str | None = None
    pca_tags: Sequence[str] = ()
    mode: str = "semi_autonomous"
    post_training_only: bool = False
    causal: bool = False


@dataclass
class Run:
    alerts: DataFrame
    sessions: DataFrame
    recommendations: DataFrame
    decisions: DataFrame
    executions: DataFrame
    outcomes: DataFrame


def baseline_per_series(readings: DataFrame, cfg: Settings, seconds: int | None) -> DataFrame:
    """Limits from the baseline scenario of each asset, or from each series' own first part."""
    if cfg.baseline_scenario is None:
        return charts.fit_baseline(readings, SERIES, cfg.training_fraction, seconds=seconds)
    base = charts.fit_baseline(readings.filter(F.col("scenario") == cfg.baseline_scenario), ["asset", "tag"])
    series = readings.select(*SERIES).distinct()
    return series.join(base, ["asset", "tag"])


def detect(readings: DataFrame, dim: DataFrame, cfg: Settings, extra: Sequence[Detector] = (),
           seconds: int | None = None) -> DataFrame:
    """All detectors over all series, minus the warm-up of each run."""
    ensure_checkpoint_dir(readings.sparkSession)
    base = baseline_per_series(readings, cfg, seconds).checkpoint()
    live = readings
    if cfg.post_training_only:
        live = charts.evaluation_rows(readings, cfg.training_fraction, seconds=seconds).drop("rn", "n_rows")
    w = rolling.rows_for(20, cfg.period_s, 5)
    streams = [
        charts.shewhart_alerts(live, base, seconds=seconds),
        charts.ewma_alerts(live, base, seconds=seconds),
        charts.cusum_alerts(live, base, seconds=seconds),
        rolling.frozen_alerts(live.join(checked_broadcast(dim.filter("measured").select("tag")), "tag", "left_semi"),
                              w, seconds=seconds),
        rolling.trend_alerts(live, dim, rolling.rows_for(60, cfg.period_s, 5),
                             rolling.rows_for(5, cfg.period_s, 2), rolling.rows_for(1, cfg.period_s, 1),
                             seconds=seconds),
    ]
    if cfg.pca_tags:
        wide = to_wide(live, cfg.pca_tags)
        cols = [c for c in wide.columns if c not in ("asset", "scenario", "ts")]
        if cfg.baseline_scenario is None:  # what comes after the training slice must not set its own limits
            fit_on = to_wide(charts.training_rows(
                readings.filter(F.col("tag").isin(list(cfg.pca_tags))), cfg.training_fraction, seconds=seconds), cfg.pca_tags)
        else:
            fit_on = wide.filter(F.col("scenario") == cfg.baseline_scenario)
        models = pca.fit_pca_by(fit_on, cols).checkpoint()
        streams.append(pca.pca_alerts_by(wide, models, cols, seconds=seconds))
    streams += [d(live) for d in extra]
    return after_warmup(union_alerts(*streams), run_starts(live), cfg.warmup_minutes)


def monitor(readings: DataFrame, dim: DataFrame, cfg: Settings = Settings(),
            rules: Sequence[Rule] = tuple(PILOT_RULES), policy: tuple[Column, Column, str] | None = None,
            extra: Sequence[Detector] = ()) -> Run:
    """Run stage by stage.

    Each event table is far smaller than its input and used by several later stages, so
    it is checkpointed: later plans stay short and survive lost executors.
    """
    ensure_checkpoint_dir(readings.sparkSession)
    seconds = chunk_seconds_for(readings, SERIES)
    if seconds is None:  # every series fits a task: cut in order, so that later steps neither scan the source nor sort from scratch
        readings = readings.repartition(*SERIES).sortWithinPartitions(*SERIES, "ts").checkpoint()
    alerts = detect(readings, dim, cfg, extra, seconds).checkpoint()
    sessions = sessionise(alerts, cfg.gap_minutes,
                          chunk_seconds_for(alerts, ["asset", "scenario", "detector"])).checkpoint()
    ctx = session_context(sessions, readings, causal=cfg.causal, seconds=seconds)
    per_run = chunk_seconds_for(sessions, ["asset", "scenario"], "start_ts")
    recs = recommend(ctx, list(rules), seconds=per_run).checkpoint()
    decided = dec.decide(recs, dim.select("tag", "safe_min", "safe_max"), cfg.mode, policy).checkpoint()
    executed = dec.execute(decided, cfg.mode)
    outcomes = dec.measure(executed, recs, readings, seconds=seconds)
    return Run(alerts, sessions, recs, decided, executed, outcomes)
