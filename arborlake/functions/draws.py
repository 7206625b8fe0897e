"""Random draws as Column expressions, keyed by row so that results do not depend on partitioning."""

import math

import numpy as np
from pyspark.sql import Column, functions as F

_UNIT = float(1 << 53)


def uniform(keys: list[Column], seed: int, stream: int | Column = 0) -> Column:
    """Uniform draw in [0, 1) from a hash of the row keys, the seed and a stream number."""
    stream = stream if isinstance(stream, Column) else F.lit(stream)
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed), stream), 11) / F.lit(_UNIT)


def normal(keys: list[Column], seed: int, stream: int | Column = 0) -> Column:
    """Standard normal draw (Box-Muller) from two uniforms."""
    stream = stream if isinstance(stream, Column) else F.lit(stream)
    u = 1 - uniform(keys, seed, 2 * stream)
    v = uniform(keys, seed, 2 * stream + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def _beta_quantiles(alpha: float, beta: float, n: int = 1024) -> list[float]:
    """Inverse distribution function at i/n, by summing the density on a fine grid.

    The substitution 1 - x = w^(1/beta) removes the pole of the density at 1.
    """
    w = np.linspace(0.0, 1.0, 200_001)
    mid = (w[1:] + w[:-1]) / 2
    # x = 1 - w^(1/beta): density x^(a-1) (1-x)^(b-1) dx is proportional to x^(a-1) dw.
    mass = np.cumsum((1 - mid ** (1 / beta)) ** (alpha - 1))
    tail = np.concatenate([[0.0], mass / mass[-1]])  # P(X > x(w))
    at = np.interp(1 - np.arange(n + 1) / n, tail, w)
    return list(np.clip(1 - at ** (1 / beta), 0.0, 1.0))


def beta(u: Column, alpha: float = 2.5, beta_: float = 0.8, low: float = 1e-6) -> Column:
    """Beta draw from a uniform, by linear interpolation in a table of quantiles; kept in [low, 1]."""
    n = 1024
    text = ",".join(f"{q:.9g}" for q in _beta_quantiles(alpha, beta_, n))
    table = F.split(F.lit(text), ",").cast("array<double>")
    at = u * n
    i = F.floor(at).cast("int")
    value = F.get(table, i) * (1 - (at - i)) + F.get(table, i + 1) * (at - i)
    return F.least(F.greatest(value, F.lit(low)), F.lit(1.0))


def first_inside(tries: int, draw, keep, fallback: Column) -> Column:
    """First of several draws that is kept, else the fallback; ``draw`` maps a stream number to a value."""
    def step(acc: Column, i: Column) -> Column:
        return F.when(acc.isNotNull(), acc).otherwise(F.transform(F.array(draw(i)), lambda x: F.when(keep(x), x))[0])

    # A try is drawn only while none was kept.
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast("double"), step), fallback)


def truncated_lognormal(mean: Column, sd: Column, keys: list[Column], seed: int, cutoff: float = 8.0, tries: int = 20) -> Column:
    """Lognormal with given mean and sd, kept in [max(cutoff, mean/10), max(mean + 3 sd, 1.5 mean)]."""
    spread = F.sqrt(F.log1p((sd / mean) * (sd / mean)))
    centre = F.log(mean) - spread * spread / 2
    lo, hi = F.greatest(F.lit(cutoff), mean * 0.1), F.greatest(mean + 3 * sd, mean * 1.5)
    return first_inside(tries, lambda i: F.exp(centre + spread * normal(keys, seed, i)), lambda x: x.between(lo, hi),
                        F.least(F.greatest(mean, lo), hi))


def truncated_normal(mean: Column, sd: Column, keys: list[Column], seed: int, cutoff: float = 8.0, tries: int = 10) -> Column:
    """Normal diameter kept above max(cutoff/2, mean/10), else the mean."""
    lo = F.greatest(F.lit(cutoff * 0.5), mean * 0.1)
    return first_inside(tries, lambda i: mean + sd * normal(keys, seed, i), lambda x: x >= lo, mean)


def size_ratio(child_mean: Column, child_sd: Column, parent_mean: Column, parent_sd: Column, keys: list[Column], seed: int, tries: int = 10) -> Column:
    """Daughter over parent diameter with the combined variation of both, kept in (0.02, 0.99)."""
    mean = child_mean / parent_mean
    cv_c, cv_p = child_sd / F.greatest(child_mean, F.lit(1e-10)), parent_sd / F.greatest(parent_mean, F.lit(1e-10))
    cv = F.sqrt(cv_c * cv_c + cv_p * cv_p)
    return first_inside(tries, lambda i: mean * (1 + cv * normal(keys, seed, i)), lambda x: (x > 0.02) & (x < 0.99),
                        F.least(F.greatest(mean, F.lit(0.02)), F.lit(0.99)))


def poisson(rate: Column, u: Column) -> Column:
    """Poisson draw by the inverse distribution function.

    The walk over the counts runs from twelve standard deviations below the rate to as many above it, where less than
    1e-15 of the law is left on either side, so no draw of a double is cut.  It starts from the logarithm of the first
    probability, as that of no event is too small for a double at high rates.
    """
    low = F.when(rate <= 600, 0).otherwise(F.floor(rate - 12 * F.sqrt(rate))).cast("int")
    most = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    factorial = F.when(low > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(low, F.lit(1))), F.lit(0.0), lambda a, k: a + F.ln(k.cast("double")))).otherwise(F.lit(0.0))
    start = F.exp(F.when(low > 0, low * F.ln(rate) - factorial).otherwise(F.lit(0.0)) - rate)
    seed = F.struct(start.alias("p"), start.alias("c"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["n"] + (u > acc["c"]).cast("int")).alias("n"))

    return low + F.aggregate(F.sequence(low + 1, most), seed, step)["n"]


def weighted_pick(weights: Column, values: Column, u: Column) -> Column:
    """Value whose running weight first reaches u times the total."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    seed = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    at = F.aggregate(weights, seed, lambda a, w: F.struct(
        (a["s"] + w).alias("s"), (a["i"] + ((a["s"] + w) < u * total).cast("int")).alias("i")))["i"]
    return F.get(values, F.least(at, F.size(values) - 1))
