"""Distances and geometric rules as Column expressions."""

import math

from pyspark.sql import Column, functions as F

from arborlake.functions.vectors import Triple, clamp, dot, norm, plus, scale, sub

# Fixed values.
DEGENERATE_SQ = 1e-30  # squared length below which a segment counts as a point
RHO_TH = 0.83  # radius ratio that separates sprouting from branching
CHI_TH = 0.83  # closeness above which a junction takes a third branch
ANGLE_CAP = 1.31  # rad, no branch bends further
STRAIGHT_CAP = 0.1  # rad, the large branch of a sprout
THREE_WAY_BUDGET = 2.1  # rad shared by three daughters


def segment_length(p: Triple, d: Triple) -> Column:
    return norm(sub(d, p))


def midpoint(p: Triple, d: Triple) -> Triple:
    return scale(plus(p, d), 0.5)


def point_segment_sq(q: Triple, p: Triple, d: Triple) -> Column:
    """Squared distance of a point to a segment."""
    axis = sub(d, p)
    length_sq = dot(axis, axis)
    t = F.when(length_sq < DEGENERATE_SQ, F.lit(0.0)).otherwise(
        clamp(dot(sub(q, p), axis) / length_sq, 0.0, 1.0)
    )
    away = sub(q, plus(p, scale(axis, t)))
    return dot(away, away)


def point_segment(q: Triple, p: Triple, d: Triple) -> Column:
    return F.sqrt(point_segment_sq(q, p, d))


def _bind(values: dict[str, Column], body) -> Column:
    """``body`` over named intermediate values, each computed once per row."""
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return F.transform(F.array(row), body)[0]


def segment_segment_sq(p1: Triple, q1: Triple, p2: Triple, q2: Triple) -> Column:
    """Squared distance between two segments (closest-point method of Ericson 2005, 5.1.9)."""
    d1, d2, r = sub(q1, p1), sub(q2, p2), sub(p1, p2)
    zero = F.lit(0.0)

    def on_first(v: Column) -> Column:
        a, e, b, c, f = v["a"], v["e"], v["b"], v["c"], v["f"]
        denom = a * e - b * b
        s = (
            F.when(a < DEGENERATE_SQ, zero)
            .when(e < DEGENERATE_SQ, clamp(-c / a, 0.0, 1.0))
            .when(denom > DEGENERATE_SQ, clamp((b * f - c * e) / denom, 0.0, 1.0))
            .otherwise(zero)
        )
        return _bind({"s": s}, lambda w: on_second(v, w["s"]))

    def on_second(v: Column, s: Column) -> Column:
        a, e, b, c, f = v["a"], v["e"], v["b"], v["c"], v["f"]
        t = F.when(e < DEGENERATE_SQ, zero).otherwise((b * s + f) / e)

        # When t leaves [0, 1] it is clamped and s is found again for that end.
        def fitted(w: Column) -> Column:
            again = (
                F.when((a < DEGENERATE_SQ) | (e < DEGENERATE_SQ), s)
                .when(w["t"] < 0, clamp(-c / a, 0.0, 1.0))
                .when(w["t"] > 1, clamp((b - c) / a, 0.0, 1.0))
                .otherwise(s)
            )
            return _bind({"s": again, "t": clamp(w["t"], 0.0, 1.0)}, gap)

        return _bind({"t": t}, fitted)

    def gap(at: Column) -> Column:
        away = sub(plus(p1, scale(d1, at["s"])), plus(p2, scale(d2, at["t"])))
        return dot(away, away)

    return _bind(
        {"a": dot(d1, d1), "e": dot(d2, d2), "b": dot(d1, d2), "c": dot(d1, r), "f": dot(d2, r)}, on_first
    )


def box_gap_sq(lo1: Triple, hi1: Triple, lo2: Triple, hi2: Triple) -> Column:
    """Squared gap between two boxes, 0 when they touch."""
    gaps = [
        F.greatest(l2 - h1, l1 - h2, F.lit(0.0)) for l1, h1, l2, h2 in zip(lo1, hi1, lo2, hi2)
    ]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def box_reach_sq(lo1: Triple, hi1: Triple, lo2: Triple, hi2: Triple) -> Column:
    """Squared distance no two points of the boxes exceed."""
    spans = [F.greatest(h2 - l1, h1 - l2) for l1, h1, l2, h2 in zip(lo1, hi1, lo2, hi2)]
    return sum((g * g for g in spans[1:]), spans[0] * spans[0])


def closeness(parent_radius: Column, distance: Column) -> Column:
    """chi: circumference of the parent over the distance of two nodes; infinite at distance 0."""
    return F.when(distance <= 0, F.lit(float("inf"))).otherwise(2 * math.pi * parent_radius / distance)


def radius_ratio(small: Column, large: Column) -> Column:
    return F.when(large <= 0, F.lit(0.0)).otherwise(small / large)


def junction_kind(rho: Column, threshold: float = RHO_TH) -> Column:
    return F.when(rho < threshold, F.lit("sprouting")).otherwise(F.lit("branching"))


def _bend(parent: Column, own: Column, other: Column, flat: float) -> Column:
    """Bend of one daughter when pumping cost is least; ``flat`` is the cosine for a vanishing radius."""
    den = 2 * parent**2 * own**2
    cosine = F.when(den > DEGENERATE_SQ, clamp((parent**4 + own**4 - other**4) / den, -1.0, 1.0))
    return F.least(F.acos(F.coalesce(cosine, F.lit(flat))), F.lit(ANGLE_CAP))


def two_way_angles(parent: Column, large: Column, small: Column) -> tuple[Column, Column]:
    return _bend(parent, large, small, 1.0), _bend(parent, small, large, 0.0)


def junction_angles(rho: Column, gamma: float, threshold: float = RHO_TH) -> tuple[Column, Column]:
    """Bends of the large and the small daughter from their radius ratio."""
    one = F.lit(1.0)
    sprout_l, sprout_s = two_way_angles(one, one, rho)
    branch_l, branch_s = two_way_angles(F.pow(1 + F.pow(rho, gamma), 1 / gamma), one, rho)
    sprout = rho < threshold
    return (
        F.when(sprout, F.least(sprout_l, F.lit(STRAIGHT_CAP))).otherwise(branch_l),
        F.when(sprout, sprout_s).otherwise(branch_s),
    )


def three_way_angles(radii: list[Column]) -> list[Column]:
    """Bends of three daughters, shared out by inverse radius."""
    weights = [1 / (r + 1e-20) for r in radii]
    total = weights[0] + weights[1] + weights[2]
    return [THREE_WAY_BUDGET * w / total for w in weights]


def split_radii(parent: Column, ratio, gamma: float) -> tuple[Column, Column]:
    """Large and small daughter radius for a given small/large ratio."""
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    large = parent / F.pow(1 + F.pow(ratio, gamma), 1 / gamma)
    return large, ratio * large


def remainder_radius(parent: Column, taken: Column, gamma: float) -> Column:
    """Radius left for the second daughter, null when it is not the larger one."""
    left = F.pow(parent, gamma) - F.pow(taken, gamma)
    radius = F.pow(F.when(left > 0, left), 1 / gamma)
    return F.when(radius > taken, radius)


def split_point_valid(
    t: Column, length: Column, radius: Column, new_length: Column,
    t_range=(0.05, 0.95), min_parent=0.2, length_per_diameter=0.25, min_piece=0.05, min_new=0.05,
) -> Column:
    """May a segment be split at ``t`` to take a branch of ``new_length``?"""
    return (
        (t > t_range[0])
        & (t < t_range[1])
        & (length >= F.greatest(F.lit(min_parent), length_per_diameter * 2 * radius))
        & (t * length >= max(min_piece, 1e-6))
        & ((1 - t) * length >= max(min_piece, 1e-6))
        & (new_length >= min_new)
    )
