"""Spatial operators on segments and point clouds."""

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from arborlake.functions import geometry as g
from arborlake.functions.vectors import Triple, dot, lit3, sub, triple
from arborlake.operators.trees import recent_ancestors
from arborlake.plans import blocks, boxes, passes
from arborlake.plans.cut import cut, discard
from arborlake.plans.passes import box_reach_sq

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def start() -> Triple:
    return triple("px", "py", "pz")


def end() -> Triple:
    return triple("dx", "dy", "dz")


def place() -> Triple:
    return triple("x", "y", "z")


SEGMENT = ["px", "py", "pz", "dx", "dy", "dz"]


def _seg_box() -> tuple[Triple, Triple]:
    return tuple(F.least(a, b) for a, b in zip(start(), end())), tuple(F.greatest(a, b) for a, b in zip(start(), end()))


def segment_index(segs: DataFrame, scope: list[str] = (), extras: dict[str, Column] | None = None, crowd: int = 1) -> boxes.BoxIndex:
    lo, hi = _seg_box()
    return boxes.build(segs.select("tree", "id", "px", "py", "pz", "dx", "dy", "dz", "radius_mm"), lo, hi, scope, extras, crowd=crowd)


def distance_to_place(segs: DataFrame, at: tuple[float, float, float]) -> DataFrame:
    """Distance of one place to every segment."""
    return segs.withColumn("distance", g.point_segment(lit3(at), start(), end()))


def nearest_segments(points: DataFrame, segs: DataFrame, k: int) -> DataFrame:
    """The k nearest segments of every point (qid, x, y, z), ascending; fewer when there are fewer."""
    index = segment_index(segs, crowd=boxes.CROWD)
    out = boxes.k_nearest(points, ["qid"], place(), place(), index, k, g.point_segment_sq(place(), start(), end()), ["tree", "id"])
    return out.withColumn("distance", F.sqrt("d_sq")).drop("d_sq")


def segments_in_range(points: DataFrame, segs: DataFrame, radius: float) -> DataFrame:
    """All (point, segment) pairs at most ``radius`` apart."""
    d_sq = g.point_segment_sq(place(), start(), end())
    items = segs.select("tree", "id", *SEGMENT, "radius_mm")
    measure = passes.Measure(SEGMENT, passes.box_reach_sq, passes.point_ends_sq)
    out = passes.pairs(points, items, None, ["tree", "id"], measure, limit=radius * radius)
    if out is not None:
        out = out.withColumn("d_sq", d_sq).where(F.col("d_sq") <= F.lit(radius) * F.lit(radius))
    else:
        out = boxes.within(points, ["qid"], place(), place(), segment_index(segs, crowd=boxes.CROWD), F.lit(radius), d_sq)
    return out.withColumn("distance", F.sqrt("d_sq")).drop("d_sq")


def _cloud(surfaces: DataFrame) -> DataFrame:
    return surfaces.select("surface", F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"),
                           F.col("z").alias("sz"), "nx", "ny", "nz")


def surface_index(surfaces: DataFrame) -> boxes.BoxIndex:
    """Cells over the samples of every surface, for any number of searches."""
    s = triple("sx", "sy", "sz")
    return boxes.build(_cloud(surfaces), s, s, ["surface"], crowd=boxes.CROWD)


def nearest_surface_point(points: DataFrame, surfaces: DataFrame | boxes.BoxIndex) -> DataFrame:
    """Nearest sample of each surface and the signed offset along its normal (<= 0 is inside).

    ``points`` has (qid, surface, x, y, z): one row per point and surface asked for.
    """
    spot = ["sx", "sy", "sz"]
    away = sub(place(), triple(*spot))
    out, keys = None, ["qid", "surface"]
    if not isinstance(surfaces, boxes.BoxIndex):
        out = passes.pairs(points, _cloud(surfaces), "surface", ["sid"], passes.Measure(spot, passes.box_reach_sq, passes.point_point_sq))
    offset = dot(away, triple("nx", "ny", "nz"))
    if out is not None:  # the offset first, so that the exchange holds no more than is asked for
        return boxes.nearest_of(out.withColumn("offset", offset), keys, None, ["sid"]).drop("rank")
    index = surfaces if isinstance(surfaces, boxes.BoxIndex) else surface_index(surfaces)
    out = boxes.k_nearest(points, keys, place(), place(), index, 1, dot(away, away), ["sid"])
    return out.withColumn("offset", offset).drop("rank")


def project_to_surface(points: DataFrame, surfaces: DataFrame, repeats: int = 3) -> DataFrame:
    """Outside points moved back along the normal of their nearest sample, repeated while still outside.

    Cells are built once, where they are needed; each turn is written, so that none replays the turns before it.
    """
    back = points.select("qid", "surface", "x", "y", "z")
    index = surfaces if passes.travels(back, surfaces) else surface_index(surfaces)
    out = F.col("offset") > 0
    for turn in range(repeats + 1):
        push = F.col("offset") + (0.0 if turn == 0 else 1e-6)
        before, back = back, cut(nearest_surface_point(back, index).select("qid", "surface", *[
            F.when(out, q - push * v).otherwise(q).alias(a) for a, q, v in zip("xyz", place(), triple("nx", "ny", "nz"))
        ]), "pushed")
        discard(before)
    return back


def shell_distance(points: DataFrame, surfaces: DataFrame, outer: str, cavities: list[str]) -> DataFrame:
    """Signed distance to an outer surface with cavities: the worst of outer and negated cavity offsets."""
    wanted = points.withColumn("surface", F.explode(F.array(*[F.lit(s) for s in (outer, *cavities)])))
    found = nearest_surface_point(wanted, surfaces)
    violation = F.when(F.col("surface") == outer, F.col("offset")).otherwise(-F.col("offset"))
    cavity = F.when(F.col("surface") != outer, violation)
    return found.groupBy("qid").agg(
        F.max(violation).alias("shell_sd"),
        F.max(F.when(F.col("surface") == outer, F.col("offset"))).alias("outer_sd"),
        F.max(cavity).alias("worst_cavity_sd"),
        F.max_by(F.when(F.col("surface") != outer, F.col("surface")), cavity).alias("worst_cavity"),
    )


def project_to_shell(points: DataFrame, surfaces: DataFrame, outer: str, cavities: list[str]) -> DataFrame:
    """Outside points moved onto the violated wall of a shell."""
    wanted = points.withColumn("surface", F.explode(F.array(*[F.lit(s) for s in (outer, *cavities)])))
    found = nearest_surface_point(wanted, surfaces)
    is_outer = F.col("surface") == outer
    violation = F.when(is_outer, F.col("offset")).otherwise(-F.col("offset"))
    # On a tie the outer wall wins.
    worst = F.max_by(F.struct("surface", "offset", "nx", "ny", "nz", "x", "y", "z"), F.struct(violation, is_outer))
    w = found.groupBy("qid").agg(worst.alias("w"), F.max(violation).alias("shell_sd"))
    step = F.when(F.col("w.surface") == outer, -F.col("w.offset")).otherwise(-F.col("w.offset") + 1e-6)
    return w.select("qid", "shell_sd", *[
        F.when(F.col("shell_sd") <= 0, F.col(f"w.{a}")).otherwise(F.col(f"w.{a}") + step * F.col(f"w.n{a}")).alias(a)
        for a in "xyz"
    ])


def nearest_tree(points: DataFrame, segs: DataFrame) -> DataFrame:
    """Name of the tree of the nearest segment and its distance."""
    return nearest_segments(points, segs, 1).select("qid", F.col("tree").alias("nearest_tree"), "distance")


def collisions(segs: DataFrame, min_distance: float) -> DataFrame:
    """Ends of segments closer than ``min_distance`` (strict) to a segment of another tree, with that distance."""
    items = blocks.numbered(segs.select("tree", "id", "px", "py", "pz", "dx", "dy", "dz"), "tree", "own")
    found = blocks.nearest_of_others(items, ["tree", "id"], end(), limit_sq=min_distance**2)
    return found.where(F.col("d_sq") < min_distance**2).select("tree", "id", F.sqrt("d_sq").alias("distance"))


def intersections(segs: DataFrame, min_distance: float, hop_limit: int = 8) -> DataFrame:
    """Pairs of segments closer than ``min_distance`` (strict) that are not near each other in one tree."""
    up = recent_ancestors(segs, hop_limit)
    items = blocks.numbered(segs.select("tree", "id", "px", "py", "pz", "dx", "dy", "dz").join(up, ["tree", "id"]), "tree", "t")

    def apart(a: pa.Table, b: pa.Table, d_sq: np.ndarray) -> list[pa.Array]:
        ta, tb, ia, ib = (np.asarray(x.column(c)) for x, c in ((a, "t"), (b, "t"), (a, "id"), (b, "id")))
        names = pc.less(a.column("tree"), b.column("tree"))
        some = np.flatnonzero(np.asarray(pc.fill_null(names, False)) | ((ta == tb) & (ia < ib)))
        same = some[ta[some] == tb[some]]
        x, y = (_padded(z.column("up").take(pa.array(same)), hop_limit + 1) for z in (a, b))
        close = np.zeros(len(same), bool)
        for i in range(hop_limit + 1):
            for j in range(hop_limit + 1 - i):
                close |= (x[i] == y[j]) & (x[i] >= 0)
        gone = np.zeros(len(d_sq), bool)
        gone[same[close]] = True
        stay = pa.array(some[~gone[some]])
        return [*[z.column(c).take(stay) for z in (a, b) for c in ("tree", "id")], pa.array(np.sqrt(d_sq[np.asarray(stay)]))]

    kinds = {f.name: f.dataType for f in items.schema.fields}
    made = [T.StructField(f"{x}_{c}", kinds[c]) for x in "ab" for c in ("tree", "id")] + [T.StructField("distance", T.DoubleType())]
    return blocks.segments_within(items.where("t IS NOT NULL AND id IS NOT NULL"), ["tree", "id", "t", "up"], min_distance, apart, made)


def _padded(lists, width: int) -> np.ndarray:
    """Lists of ids as rows of places, -1 where a list is shorter."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, n = pc.list_flatten(lists).to_numpy(zero_copy_only=False), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    out = np.full((width, len(n)), -1, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), row] = flat
    return out


def nearest_other_terminal(terminals: DataFrame) -> DataFrame:
    """Distance of every terminal end to the nearest other end of its tree, and its volume weight d^3 / sum d^3."""
    spots = {f"p{c}": F.col(f"d{c}") for c in "xyz"}
    items = terminals.select("tree", "id", "dx", "dy", "dz").withColumns(spots).withColumn("own", F.col("id"))
    found = blocks.nearest_of_others(blocks.numbered(items, "tree", "t").where("t IS NOT NULL"), ["tree", "id"], end(), "t")
    near = found.select("tree", "id", F.sqrt("d_sq").alias("nearest"))
    # A lone terminal has no other end and takes the whole weight.
    out = terminals.select("tree", "id").join(near, ["tree", "id"], "left")
    w = F.when(F.col("nearest").isNull(), F.lit(1.0)).otherwise(F.pow("nearest", 3.0))
    total = out.groupBy("tree").agg(F.sum(w).alias("_all"))
    return out.join(total, "tree").select("tree", "id", "nearest", (w / F.col("_all")).alias("weight"))


def best_connection(points: DataFrame, segs: DataFrame, gamma: float, t_range=(0.01, 0.99),
                    steps: int = 20, junction_term: bool = False) -> DataFrame:
    """Cheapest place over all segments to attach every point, by golden-section search per segment.

    Cost is radius times length over the three pieces, with equal daughters of
    radius c r.  It is at least c r (length + gap) and at most r length + c r
    reach, so cells that cannot hold the best segment are ruled out.  ``valid``
    tells whether the found split point may be used; ties go to the first segment.
    """
    phi = (5**0.5 - 1) / 2
    radius = F.col("radius_mm")
    daughter, _ = g.split_radii(radius, 1.0, gamma)
    share = 2 ** (-1 / gamma)
    length = F.col("seg_length")
    lo, hi = _seg_box()
    items = segs.select("tree", "id", "px", "py", "pz", "dx", "dy", "dz", "radius_mm").withColumn(
        "seg_length", g.segment_length(start(), end()))
    # Cost scales with the radius, so cells hold one class of radii each; there are
    # only about four classes per doubling between the thinnest and the widest.
    items = items.withColumn("r_class", F.floor(4 * F.log2("radius_mm")))

    def junction(r):
        # Equal daughters branch rather than sprout.
        return 2 * math.pi * r * (share * r) if junction_term else F.lit(0.0)

    cell_lo, cell_hi = boxes.cell_box()
    gap = F.sqrt(g.box_gap_sq(place(), place(), cell_lo, cell_hi))
    reach_to = F.sqrt(g.box_reach_sq(place(), place(), cell_lo, cell_hi))
    least = share * F.col("b_r0") * (F.col("b_l0") + gap) + junction(F.col("b_r0"))
    most = F.col("b_r1") * F.col("b_l1") + share * F.col("b_r1") * reach_to + junction(F.col("b_r1"))

    def reach(t):
        return g.segment_length(tuple(p + t * (d - p) for p, d in zip(start(), end())), place())

    def tubes(t):
        return radius * t * length + daughter * (1 - t) * length + daughter * reach(t)

    def narrow(acc, _):
        a, b = acc["a"], acc["b"]
        left, right = b - phi * (b - a), a + phi * (b - a)
        lower = tubes(left) < tubes(right)
        return F.struct(F.when(lower, a).otherwise(left).alias("a"), F.when(lower, right).otherwise(b).alias("b"))

    seed = F.struct(F.lit(t_range[0]).alias("a"), F.lit(t_range[1]).alias("b"))
    span = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), seed, narrow)

    def scored(df: DataFrame) -> DataFrame:
        found = df.withColumn("_s", span).withColumn("t", (F.col("_s.a") + F.col("_s.b")) / 2)
        return found.withColumn("d_sq", tubes(F.col("t")) + junction(radius))

    items = items.where("r_class IS NOT NULL")
    priced = items.withColumn("_thin", daughter)
    measure = passes.Measure(SEGMENT, *_connection(share, t_range, steps, junction_term), extras=("radius_mm", "seg_length", "_thin"),
                             kind=lambda v: np.floor(4 * np.log2(v[6])), costly=True)
    found = passes.pairs(points, priced, None, ["tree", "id"], measure)
    if found is not None:
        found = boxes.nearest_of(found, ["qid"], scored, ["tree", "id"])
    else:
        classes = [r[0] for r in items.select("r_class").distinct().collect()]
        asked = points.withColumn("r_class", F.explode(F.array(*[F.lit(c) for c in classes])))
        index = boxes.build(items, lo, hi, ["r_class"], extras={
            "b_r0": F.min("radius_mm"), "b_r1": F.max("radius_mm"), "b_l0": F.min("seg_length"), "b_l1": F.max("seg_length")}, crowd=boxes.CROWD)
        found = boxes.k_nearest(asked, ["qid"], place(), place(), index, 1, scored, ["tree", "id"], least=least, most=most)
    return found.select(
        "qid", "tree", "id", "t", F.col("d_sq").alias("cost"),
        g.split_point_valid(F.col("t"), length, radius, reach(F.col("t"))).alias("valid"),
    )


def _connection(share: float, t_range: tuple[float, float], steps: int, junction_term: bool):
    """Bounds and cost of a connection for arrays, with the operations of ``best_connection`` in their order."""
    phi = (5**0.5 - 1) / 2

    def junction(r):
        return 2 * math.pi * r * (share * r) if junction_term else 0.0

    def reach(q, mins, maxs):
        least, most = (np.sqrt(x) for x in box_reach_sq(q, mins, maxs))
        r0, l0, r1, l1 = mins[3], mins[4], maxs[3], maxs[4]
        return share * r0 * (l0 + least) + junction(r0), r1 * l1 + share * r1 * most + junction(r1)

    def cost(q, s):
        p, axis, radius, length, daughter = s[:3], s[3:6] - s[:3], s[6], s[7], s[8]

        def tubes(t):
            x, y, z = q - (p + t * axis)
            return radius * t * length + daughter * (1 - t) * length + daughter * np.sqrt(x * x + y * y + z * z)

        a, b = (np.full(q.shape[1], float(t)) for t in t_range)
        for _ in range(steps):
            left, right = b - phi * (b - a), a + phi * (b - a)
            lower = tubes(left) < tubes(right)
            a, b = np.where(lower, a, left), np.where(lower, right, b)
        return tubes((a + b) / 2) + junction(radius)

    return reach, cost


def merge_candidates(points: DataFrame, junctions: DataFrame, chi_th: float = g.CHI_TH) -> DataFrame:
    """Two-way junction with the largest closeness above the threshold for every point.

    Closeness exceeds the threshold only within 2 pi r / threshold.  It grows with the radius, so cells hold one class of
    radii each, and a cell is dropped when another one proves a closer junction or when it is out of reach.
    """
    spot = triple("dx", "dy", "dz")
    items = junctions.select("tree", "id", "dx", "dy", "dz", "radius_mm").withColumn("r_class", F.floor(2 * F.log2("radius_mm")))
    # Radii that are not positive are never close enough.
    items = items.where(F.col("radius_mm") > 0)
    classes = [r[0] for r in items.select("r_class").distinct().collect()]
    asked = points.withColumn("r_class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<bigint>")))
    index = boxes.build(items, spot, spot, ["r_class"], extras={"b_r0": F.min("radius_mm"), "b_r1": F.max("radius_mm")}, crowd=boxes.CROWD)
    away = sub(place(), spot)
    cell_lo, cell_hi = boxes.cell_box()
    gap = F.sqrt(g.box_gap_sq(place(), place(), cell_lo, cell_hi))
    reach = F.sqrt(g.box_reach_sq(place(), place(), cell_lo, cell_hi))
    # The score is -chi, so its bounds are negative and widened by hand.
    least, most = -g.closeness(F.col("b_r1"), gap) * (1 + 1e-8), -g.closeness(F.col("b_r0"), reach)
    found = boxes.k_nearest(
        asked, ["qid"], place(), place(), index, 1, -g.closeness(F.col("radius_mm"), F.sqrt(dot(away, away))), ["tree", "id"],
        least=least, most=most, limit_sq=-chi_th)
    return found.where(-F.col("d_sq") > chi_th).select("qid", "tree", "id", (-F.col("d_sq")).alias("chi"))
