"""Threshold ladders and scores, all plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose threshold is strictly exceeded, steps given highest first."""
    out = None
    for threshold, label in steps:
        out = F.when(value > threshold, label) if out is None else out.when(value > threshold, label)
    return out.otherwise(otherwise)


# Severity thresholds per detector family.
SIGMA_STEPS = [(8.0, "critical"), (5.0, "high"), (3.5, "medium")]
SHIFT_STEPS = [(6.0, "critical"), (3.0, "high"), (1.5, "medium")]
RATIO_STEPS = [(10.0, "critical"), (4.0, "high"), (2.0, "medium")]
DIVERGENCE_STEPS = [(4.0, "high"), (2.0, "medium")]


def severity_from_sigma(deviation: Column) -> Column:
    return ladder(deviation, SIGMA_STEPS, "low")


def severity_from_shift(shift: Column) -> Column:
    return ladder(shift, SHIFT_STEPS, "low")


def severity_from_ratio(ratio: Column) -> Column:
    return ladder(ratio, RATIO_STEPS, "low")


def severity_from_divergence(ratio: Column) -> Column:
    return ladder(ratio, DIVERGENCE_STEPS, "low")


def severity_from_minutes(minutes: Column) -> Column:
    """Nearer limits are worse: <5 critical, <15 high, <30 medium."""
    return (
        F.when(minutes < 5, "critical").when(minutes < 15, "high")
        .when(minutes < 30, "medium").otherwise("low")
    )


def priority_score(urgency: Column, confidence: Column) -> Column:
    base = (
        F.when(urgency == "critical", 90.0).when(urgency == "high", 70.0)
        .when(urgency == "medium", 50.0).otherwise(25.0)
    )
    return base + 10.0 * confidence


def urgency_from_severity(severity: Column) -> Column:
    return F.when(severity == "info", "low").otherwise(severity)


def agreement(measured: Column, predicted: Column, scale: float = 5.0) -> Column:
    """Measured-vs-predicted agreement in [0, 1]."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(measured - predicted) / scale)


def psi_status(psi: Column) -> Column:
    return F.when(psi >= 0.25, "significant").when(psi >= 0.10, "moderate").otherwise("none")
