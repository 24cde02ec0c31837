"""Objectives of the operating-point search as named Column specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Objective:
    """A column to rank by; `low`/`high` normalise gains, `weight` scales them."""

    name: str
    direction: str
    weight: float
    low: float
    high: float

    def spec(self) -> tuple[str, str, float, float, float]:
        return self.name, self.direction, self.weight, self.low, self.high


# The four objectives with weight and nominal range.
PILOT_OBJECTIVES = [
    Objective("purity", "maximize", 1.0, 95.0, 99.8),
    Objective("energy", "minimize", 1.0, 150.0, 350.0),
    Objective("production", "maximize", 0.7, 1.5, 2.5),
    Objective("stability", "minimize", 0.3, 0.0, 5.0),
]


def purity_objective(purity: Column, spec: float = 98.5) -> Column:
    """Purity, minus ten times the shortfall when below spec."""
    return F.when(purity < spec, purity - 10.0 * (spec - purity)).otherwise(purity)


def production_objective(feed: Column, conversion: Column) -> Column:
    return feed * conversion * 8.0


def stability_objective(temperature: Column, setpoint: float = 79.2) -> Column:
    return F.abs(temperature - setpoint)


def with_objectives(df: DataFrame, purity: Column, energy: Column, feed: Column, conversion: Column,
                    temperature: Column) -> DataFrame:
    return df.withColumns({
        "purity": purity_objective(F.coalesce(purity, F.lit(0.0))),
        "energy": F.coalesce(energy, F.lit(float("inf"))),
        "production": production_objective(F.coalesce(feed, F.lit(0.0)), F.coalesce(conversion, F.lit(0.0))),
        "stability": stability_objective(F.coalesce(temperature, F.lit(79.2))),
    })
