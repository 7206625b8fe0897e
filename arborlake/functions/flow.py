"""Flow formulas as Column expressions. Units are in the argument names."""

import math

from pyspark.sql import Column, functions as F

# Fixed values.
GAMMA = 7 / 3
VISCOSITY = 0.0035  # Pa s
ROOT_PA = 13332.0
TERMINAL_PA = 3999.6
ML_PER_MIN = 6e7  # m3/s to mL/min
HEMATOCRIT = 0.45


def resistance(length_mm: Column, radius_mm: Column, viscosity=VISCOSITY) -> Column:
    """Pressure drop per flow of a round tube."""
    return 8 * viscosity * (length_mm * 1e-3) / (math.pi * F.pow(radius_mm * 1e-3, 4.0))


def volume_ml(length_mm: Column, radius_mm: Column) -> Column:
    return math.pi * radius_mm * radius_mm * length_mm / 1000.0


def transit_time_s(volume: Column, flow_m3_s: Column, label: Column) -> Column:
    """Volume over flow; a segment that carries no flow is an error that names it."""
    still = F.abs(flow_m3_s) <= 1e-18
    message = F.concat(F.lit("no flow in segment "), label.cast("string"))
    return F.when(still, F.raise_error(message).cast("double")).otherwise(
        F.greatest(volume * 1e-6 / F.abs(flow_m3_s), F.lit(1e-9))
    )


def gamma_variate(t: Column, amplitude: float, t0: float, tmax: float, alpha: float) -> Column:
    """Bolus curve that starts at ``t0`` and peaks at ``tmax``."""
    if tmax <= t0:
        raise ValueError("tmax must lie after t0")
    u = (t - t0) / (tmax - t0)
    return F.when(t > t0, amplitude * F.pow(u, alpha) * F.exp(alpha * (1 - u))).otherwise(F.lit(0.0))


def pulse(t: Column, value: float, t0: float, duration: float) -> Column:
    return F.when(t <= t0 + duration, F.lit(float(value))).otherwise(F.lit(0.0))


def in_band_scaled(value: Column, size_um: Column, factor: float = 1.6, lo: float = 0.0, hi: float = 400.0) -> Column:
    return F.when(size_um.between(lo, hi), value * factor).otherwise(value)


def class_by_bounds(value: Column, lower_bounds: list[float]) -> Column:
    """Index of the highest inclusive lower bound that is reached, -1 below all."""
    out = F.lit(-1)
    for i, bound in enumerate(lower_bounds):
        out = F.when(value >= float(bound), F.lit(i)).otherwise(out)
    return out


def class_by_bound_array(value: Column, lower_bounds: Column) -> Column:
    return F.size(F.filter(lower_bounds, lambda b: value >= b)) - 1


def nearest_bin(value: Column, bins: list[float]) -> Column:
    """Index (from 1) of the nearest bin, the lower one on ties."""
    ranked = F.array(*[F.struct(F.abs(value - float(b)).alias("d"), F.lit(i + 1).alias("i")) for i, b in enumerate(bins)])
    return F.array_min(ranked)["i"]


def pries_viscosity(diameter_um: Column) -> Column:
    """Apparent viscosity in small vessels in Pa s (Pries et al. 1994, in-vivo law)."""
    # The coefficients of the published law; plasma at 0.012 poise.
    d = F.greatest(diameter_um, F.lit(2.0))
    at_045 = 6.0 * F.exp(-0.085 * d) + 3.2 - 2.44 * F.exp(-0.06 * F.pow(d, 0.645))
    saturation = 1 / (1 + 1e-11 * F.pow(d, 12.0))
    shape = (0.8 + F.exp(-0.075 * d)) * (saturation - 1) + saturation
    hematocrit_part = (F.pow(F.lit(1 - HEMATOCRIT), shape) - 1) / (F.pow(F.lit(1 - 0.45), shape) - 1)
    layer = F.pow(d / (d - 1.1), 2.0)
    return (1 + (at_045 - 1) * hematocrit_part * layer) * layer * 0.012 * 0.1


def resistance_by_diameter(length_mm: Column, diameter_um: Column) -> Column:
    """Tube resistance with the diameter-dependent viscosity."""
    length_m = F.when(length_mm <= 0, F.lit(1e-9)).otherwise(length_mm * 1e-3)
    r = 128 * pries_viscosity(diameter_um) * length_m / (math.pi * F.pow(diameter_um * 1e-6, 4.0))
    return F.greatest(r, F.lit(1e-20))
