"""Small vector helpers on triples of Columns."""

from pyspark.sql import Column, functions as F

Triple = tuple[Column, Column, Column]


def triple(*names: str, of: str | None = None) -> Triple:
    """Columns by name, e.g. ``triple("px", "py", "pz")``; ``of`` is an optional table alias."""
    return tuple(F.col(f"{of}.{n}" if of else n) for n in names)


def sub(a: Triple, b: Triple) -> Triple:
    return tuple(x - y for x, y in zip(a, b))


def plus(a: Triple, b: Triple) -> Triple:
    return tuple(x + y for x, y in zip(a, b))


def scale(a: Triple, s) -> Triple:
    return tuple(x * s for x in a)


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Triple, b: Triple) -> Triple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Triple) -> Column:
    return F.sqrt(dot(a, a))


def clamp(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(x, lo), hi)


def as_struct(a: Triple) -> Column:
    return F.struct(a[0].alias("x"), a[1].alias("y"), a[2].alias("z"))


def of_struct(s: Column) -> Triple:
    return (s["x"], s["y"], s["z"])


def lit3(p) -> Triple:
    return tuple(F.lit(float(v)) for v in p)


def perpendicular(d: Triple) -> Triple:
    """Unit vector at right angles to the unit vector ``d``: cross product with its weakest axis."""
    ax, ay, az = (F.abs(v) for v in d)
    use_x = (ax <= ay) & (ax <= az)
    use_y = ~use_x & (ay <= az)
    one, zero = F.lit(1.0), F.lit(0.0)
    axis = (
        F.when(use_x, one).otherwise(zero),
        F.when(use_y, one).otherwise(zero),
        F.when(use_x | use_y, zero).otherwise(one),
    )
    p = cross(d, axis)
    return scale(p, 1 / norm(p))
