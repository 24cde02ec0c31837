"""What-if sensor faults applied to recorded series (columns of t0-relative time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def freeze(value: Column, hours: Column, start_h: float, stuck_at: Column | float) -> Column:
    held = stuck_at if isinstance(stuck_at, Column) else F.lit(float(stuck_at))
    return F.when(hours >= start_h, held).otherwise(value)


def drift(value: Column, hours: Column, start_h: float, per_hour: float, ceiling: float = 100.0) -> Column:
    """Linear drift after the start; the whole series is clipped at the ceiling."""
    moved = F.when(hours >= start_h, value + per_hour * (hours - start_h)).otherwise(value)
    return F.least(moved, F.lit(float(ceiling)))


def bias(value: Column, hours: Column, start_h: float, first_value: Column, share: float = 0.05) -> Column:
    """Constant offset: a share of the series' first value."""
    return F.when(hours >= start_h, value + share * first_value).otherwise(value)


def relative_drift(value: Column, hours: Column, start_h: float, share_per_hour: float = 0.01) -> Column:
    return F.when(hours >= start_h, value * (1.0 + share_per_hour * (hours - start_h))).otherwise(value)


def noise(value: Column, hours: Column, start_h: float, key: Column, share: float = 0.05) -> Column:
    """Repeatable Gaussian noise (Box–Muller on a hash of `key`)."""
    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    z = F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * F.lit(3.141592653589793) * uniform(2))
    return F.when(hours >= start_h, value + share * F.abs(value) * z).otherwise(value)
