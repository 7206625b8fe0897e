"""Distribution functions as Column expressions."""

import math

from pyspark.sql import Column, functions as F

# Hart's double-precision rational for the normal cdf as printed in
# West (2005), "Better approximations to cumulative normal functions".
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
        112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
        296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_SPLIT = 7.07106781186547
_ROOT_2PI = 2.506628274631


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    x = F.abs(z)
    bell = F.exp(-x * x / 2)
    near = bell * _horner(x, _NUM) / _horner(x, _DEN)
    far = bell / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / _ROOT_2PI
    tail = F.when(x > 37, F.lit(0.0)).when(x < _SPLIT, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    """The same function as a SQL expression, for engines without one."""

    def horner(x, cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out}*{x}+{c!r})"
        return out

    x = f"abs({z})"
    bell = f"exp(-{x}*{x}/2)"
    near = f"({bell}*{horner(x, _NUM)}/{horner(x, _DEN)})"
    far = f"({bell}/({x}+1/({x}+2/({x}+3/({x}+4/({x}+0.65)))))/{_ROOT_2PI})"
    tail = f"(CASE WHEN {x}>37 THEN 0.0 WHEN {x}<{_SPLIT} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z}>0 THEN 1-{tail} ELSE {tail} END)"


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(X > x) for a whole number of degrees of freedom, from the finite sums of the even and odd case."""
    h = x / 2
    odd = dof % 2 == 1
    # Terms h^(i - 1/2)/Gamma(i + 1/2) (odd) or h^i/i! (even), each from the one before.
    first = F.when(odd, F.sqrt(h) / (math.sqrt(math.pi) / 2)).otherwise(F.lit(1.0))
    n_terms = F.when(odd, (dof - 1) / 2).otherwise(dof / 2).cast("int")
    seed = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))

    def step(acc, i):
        ratio = h / F.when(odd, i + 0.5).otherwise(i.cast("double"))
        return F.struct((acc["term"] * ratio).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    steps = F.when(n_terms > 0, F.sequence(F.lit(1), n_terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, seed, step)["sum"] * F.exp(-h)
    head = F.when(odd, 2 * (1 - normal_cdf(F.sqrt(x)))).otherwise(F.lit(0.0))
    return F.when(x <= 0, F.lit(1.0)).otherwise(head + total)


def kolmogorov_p(n: Column, d: Column) -> Column:
    """Asymptotic p-value of a one-sample KS distance, four terms of the series."""
    root = F.sqrt(n.cast("double"))
    lam = (root + 0.12 + 0.11 / root) * d
    series = sum(
        (F.lit(2.0 * (-1) ** (k + 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(2, 5)),
        2.0 * F.exp(-2.0 * lam * lam),
    )
    return (
        F.when(lam <= 0, F.lit(1.0))
        .when(lam > 3.1, F.lit(0.0))
        .otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    )
