"""First-principles consistency columns for a reactor and a distillation column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def damkohler(k0: float, ea_over_r: float, t_kelvin: Column, volume: float, flow_per_hour: Column) -> Column:
    """Rate constant times residence time in minutes."""
    return F.lit(k0) * F.exp(-ea_over_r / t_kelvin) * (volume / (flow_per_hour / 60.0))


def conversion_from_damkohler(da: Column) -> Column:
    return da / (1.0 + da)


def adiabatic_rise(heat: float, feed_concentration: Column, density: float, heat_capacity: float) -> Column:
    return F.lit(-heat) * feed_concentration / (density * heat_capacity)


def energy_residual(c_a: Column, t_r: Column, t_j: Column, flow_per_hour: Column, *, k0: float, ea_over_r: float,
                    heat: float, volume: float, density: float, heat_capacity: float, t_feed: float,
                    ua: float) -> Column:
    """(generated − removed) / generated, zero when nothing is generated."""
    made = -heat * k0 * F.exp(-ea_over_r / t_r) * c_a * volume
    out = flow_per_hour / 60.0 * density * heat_capacity * (t_r - t_feed) + ua * (t_r - t_j)
    return F.when(F.abs(made) < 1e-6, 0.0).otherwise((made - out) / made)


def arrhenius_ratio(ea_over_r: float, t1: Column, t2: Column) -> Column:
    return F.exp(-ea_over_r * (1.0 / t2 - 1.0 / t1))


def vapour_fraction(x: Column, alpha: float) -> Column:
    return alpha * x / (1.0 + (alpha - 1.0) * x)


def fenske_stages(x_d: Column, x_b: Column, alpha: float) -> Column:
    """Null unless both compositions lie strictly inside (0, 1)."""
    ok = (x_d > 0) & (x_d < 1) & (x_b > 0) & (x_b < 1)
    return F.when(ok, F.log(x_d / (1.0 - x_d) * ((1.0 - x_b) / x_b)) / F.log(F.lit(float(alpha))))


def balance_error(z_f: Column, x_d: Column, x_b: Column, d_over_f: Column) -> Column:
    return F.abs(z_f - (d_over_f * x_d + (1.0 - d_over_f) * x_b))


def distillate_fraction(z_f: Column, x_d: Column, x_b: Column) -> Column:
    """Distillate over feed, clipped to [0.05, 0.95]; 0.5 when the products are equal."""
    ratio = (z_f - x_b) / (x_d - x_b)
    return F.when(F.abs(x_d - x_b) < 1e-6, 0.5).otherwise(F.least(F.greatest(ratio, F.lit(0.05)), F.lit(0.95)))


def column_estimate(reflux: Column, feed: Column, conversion: Column, *, alpha: float = 2.2, stages: float = 10.0,
                    latent: float = 35000.0, x_d: float = 0.95, molar: float = 8000.0) -> tuple[Column, Column]:
    """(bottom purity %, reboiler duty kW) from the Fenske and Gilliland correlations."""
    z_b = F.greatest(F.least(conversion, F.lit(0.99)), F.lit(0.01))
    r_min = F.greatest(
        (1.0 / (alpha - 1.0)) * (x_d / F.greatest(z_b, F.lit(0.01))
                                 - alpha * (1 - x_d) / F.greatest(1 - z_b, F.lit(0.01))), F.lit(0.5))
    margin = F.greatest((reflux - r_min) / (reflux + 1), F.lit(0.0))
    y = F.greatest(0.75 - 0.75 * F.pow(margin, F.lit(0.5668)), F.lit(0.001))
    n_min = F.greatest(stages * (1 - y) - y, F.lit(1.0))
    light = F.least((x_d / (1 - x_d)) / F.pow(F.lit(alpha), n_min), F.lit(0.5))
    purity = F.greatest(F.least((1 - light) * 100.0, F.lit(99.95)), F.lit(50.0))
    distillate = feed * molar * (1 - z_b) / x_d
    return purity, (reflux + 1) * distillate * latent / 3600.0 / 1000.0
