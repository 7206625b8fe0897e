"""Polylines: arc length, resampling, joining, and turning them into segments.

``line_points`` rows are (line, pos, x, y, z, radius_mm) with pos from 1 without gaps.
"""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.functions.vectors import norm, sub, triple
from arborlake.plans import boxes
from arborlake.plans.cut import cut, cut_counted
from arborlake.plans.lookup import lookup
from arborlake.plans.running import SLICE, neighbour, running_sum

POINT = ["x", "y", "z", "radius_mm"]


def arc_length(points: DataFrame) -> DataFrame:
    """Adds step (from the previous point) and s, the length so far."""
    back = neighbour(points, ["line"], "pos", -1, ["x", "y", "z"], "_b")
    step = F.coalesce(norm(sub(triple("x", "y", "z"), triple("_bx", "_by", "_bz"))), F.lit(0.0))
    stepped = back.withColumn("step", step).drop("_bx", "_by", "_bz")
    return running_sum(stepped, ["line"], "pos", {"s": F.col("step")})


def line_summary(points: DataFrame) -> DataFrame:
    """Points, radius spread, length and both ends of every line."""
    s = arc_length(points)
    end = F.struct("x", "y", "z")
    return s.groupBy("line").agg(
        F.count("*").alias("n"), F.min("radius_mm").alias("r_min"), F.max("radius_mm").alias("r_max"),
        F.avg("radius_mm").alias("r_mean"), F.max("s").alias("length_mm"),
        F.min_by(end, "pos").alias("first"), F.max_by(end, "pos").alias("last"))


def tree_summary(points: DataFrame, owned: DataFrame, joints: DataFrame) -> DataFrame:
    """Lines, points, mean radius of all points and largest gap of the joints (0 without one) of every tree.

    ``owned`` is (tree, line), ``joints`` has (tree, gap_mm).  Points are summed up by line before they meet the trees.
    """
    sums = points.groupBy("line").agg(F.count("*").alias("_n"), F.sum("radius_mm").alias("_r"))
    trees = owned.join(sums, "line").groupBy("tree").agg(
        F.count("*").alias("n_lines"), F.sum("_n").alias("n_points"), (F.sum("_r") / F.sum("_n")).alias("r_mean"))
    gaps = joints.groupBy("tree").agg(F.max("gap_mm").alias("_gap"))
    return trees.join(gaps, "tree", "left").withColumn("max_gap_mm", F.coalesce("_gap", F.lit(0.0))).drop("_gap")


def slice_from(points: DataFrame, start: Column) -> DataFrame:
    """Points from an index on (clamped to the line), renumbered."""
    n = points.count()
    size = points.groupBy("line").agg(F.max("pos").alias("_n"))
    at = F.least(F.greatest(start, F.lit(1)), F.col("_n"))
    kept = lookup(points, size, ["line"], n).where(F.col("pos") >= at)
    return kept.withColumn("pos", (F.col("pos") - at + 1).cast("int")).drop("_n")


def reversed_lines(points: DataFrame) -> DataFrame:
    n = points.count()
    size = points.groupBy("line").agg(F.max("pos").alias("_n"))
    return lookup(points, size, ["line"], n).withColumn("pos", (F.col("_n") + 1 - F.col("pos")).cast("int")).drop("_n")


def chained_segments(points: DataFrame) -> DataFrame:
    """Segment i of a line joins points i and i + 1; its parent is segment i - 1, its radius the mean."""
    ahead = neighbour(points, ["line"], "pos", 1, POINT, "_n").where(F.col("_nx").isNotNull())
    return ahead.select(
        "line", F.col("pos").alias("id"),
        F.when(F.col("pos") > 1, F.col("pos") - 1).otherwise(F.lit(-1)).alias("parent_id"),
        *[F.col(a).alias(f"p{a}") for a in "xyz"], *[F.col(f"_n{a}").alias(f"d{a}") for a in "xyz"],
        ((F.col("radius_mm") + F.col("_nradius_mm")) / 2).alias("radius_mm"))


def merge_chain(points: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines appended in ``rank`` order within ``chain``; the first point of a follower is
    dropped when it lies within the tolerance of the end it is joined to.

    ``points`` carries (chain, rank).  Only the first point of a line can be
    dropped, so the point before a seam is the last point of the line before it.
    """
    spot = F.struct("x", "y", "z")
    ends = points.groupBy("chain", "rank").agg(
        F.min_by(spot, "pos").alias("a"), F.max_by(spot, "pos").alias("b"), F.max("pos").alias("n"))
    w = Window.partitionBy("chain").orderBy("rank")
    seam = ends.withColumn("before", F.lag("b").over(w))
    gap = norm(sub(triple("x", "y", "z", of="a"), triple("x", "y", "z", of="before")))
    drop = F.coalesce((gap <= tolerance).cast("int"), F.lit(0))
    seam = seam.withColumn("_drop", drop)
    seam = seam.withColumn("_before", F.coalesce(
        F.sum(F.col("n") - F.col("_drop")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = points.count()
    out = lookup(points, seam.select("chain", "rank", "_drop", "_before"), ["chain", "rank"], n)
    return out.where(F.col("pos") > F.col("_drop")).withColumn(
        "chain_pos", (F.col("_before") + F.col("pos") - F.col("_drop")).cast("bigint")).drop("_drop", "_before")


RESAMPLE_SLICE = 500_000  # points of one line handled in one task at a time
PACKED = 1_024  # points of a line that travels as one row
LINES_BUCKET = 200_000


def resample(points: DataFrame, low: float = 0.75, high: float = 1.5, per_radius: float = 0.75,
             slice_points: int = RESAMPLE_SLICE) -> DataFrame:
    """Points re-spaced by the local radius: step = clamp(per_radius * radius, low, high).

    Every step depends on the point kept before it, but only through the arc
    length reached, so a long line is done in slices: each round takes the next
    slice of all lines that still go on and hands (s, point, radius) over.
    """
    longest = points.agg(F.max("pos")).first()[0] or 0
    measured = arc_length(points).select("line", "pos", "s", *POINT).where(F.col("line").isNotNull())
    if longest <= SLICE:
        # Where the running sums are plain windows the sizes are too, over the same rows in the same task.
        whole = Window.partitionBy("line")
        sized = cut(measured.withColumns({"n": F.max("pos").over(whole), "total": F.max("s").over(whole)}), "arc")
        n_rows = sized.count()
    else:
        measured = cut(measured, "arc")
        sizes = cut(measured.groupBy("line").agg(F.max("pos").alias("n"), F.max("s").alias("total")), "sizes")
        n_rows = measured.count()
        sized = lookup(measured, sizes, ["line"], n_rows)
    # Short lines stay as they are.
    short = (F.col("n") <= 2) | (F.col("total") <= low)
    kept = sized.where(short).select("line", F.col("pos").cast("long").alias("k"), *POINT)
    work = sized.where(~short)
    schema = "line long, k long, s double, x double, y double, z double, radius_mm double, carry boolean"
    line_type = points.schema["line"].dataType.simpleString()
    schema = schema.replace("line long", f"line {line_type}")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Kept points of all lines of a bucket, and per line the state (flag carry) that its next slice starts from.

        The lines are laid end to end on one axis of arc length, so that one sorted lookup places the next point of
        every line that still goes on; a round moves all of them by one step.
        """
        pdf = pdf.sort_values(["line", "pos"], ignore_index=True)
        names, s = pdf["line"].to_numpy(), pdf["s"].to_numpy()
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        last = np.append(first[1:], len(names)) - 1
        shift = np.concatenate([[0.0], np.cumsum(s[last] + 1.0)[:-1]])
        axis = s + np.repeat(shift, last - first + 1)
        spots = pdf[POINT].to_numpy(dtype=float)
        total, whole = pdf["total"].to_numpy()[first], pdf["pos"].to_numpy()[last] == pdf["n"].to_numpy()[last]
        if "c_k" in pdf:
            k, at = pdf["c_k"].to_numpy()[first].copy(), pdf["c_s"].to_numpy(dtype=float)[first].copy()
            here = pdf[[f"c_{c}" for c in POINT]].to_numpy(dtype=float)[first].copy()
        else:
            k, at, here = np.zeros(len(first), np.int64), np.zeros(len(first)), np.zeros((len(first), len(POINT)))
        fresh = k == 0
        k[fresh], at[fresh], here[fresh] = 1, 0.0, spots[first[fresh]]
        made = [(np.flatnonzero(fresh), k[fresh], at[fresh], here[fresh])]
        going = np.arange(len(first))
        while len(going):
            ahead = at[going] + np.clip(per_radius * np.maximum(here[going, 3], 1e-6), low, high)
            # A line rests where its end is near, or where the next slice has the place.
            rests = (ahead >= total[going] - low) | ((ahead > s[last[going]]) & ~whole[going])
            going, ahead = going[~rests], ahead[~rests]
            right = np.clip(np.searchsorted(axis, ahead + shift[going]), first[going] + 1, last[going])
            gap = s[right] - s[right - 1]
            share = np.divide(ahead - s[right - 1], gap, out=np.ones_like(gap), where=gap > 0)[:, None]
            spot = (1 - share) * spots[right - 1] + share * spots[right]
            far = ((spot - here[going])[:, :3] ** 2).sum(1) >= (low / 2) ** 2
            kept_lines = going[far]
            k[kept_lines] += 1
            at[kept_lines], here[kept_lines] = ahead[far], spot[far]
            made.append((kept_lines, k[kept_lines], at[kept_lines], here[kept_lines]))
            at[going[~far]] += low / 2  # the line turns back on itself: look further along it
        ends = np.flatnonzero(whole)
        tip = spots[last[ends]]
        near = (np.linalg.norm((tip - here[ends])[:, :3], axis=1) < low / 2) & (k[ends] > 1)
        made.append((ends, k[ends] + ~near, total[ends], tip))
        line, number, place, spot = (np.concatenate(x) for x in zip(*made))
        out = pd.DataFrame({"line": names[first[line]], "k": number, "s": place})
        out[POINT] = spot
        out = out.drop_duplicates(["line", "k"], keep="last").assign(carry=False)  # a near end replaces the last point
        if longest <= slice_points:
            return out  # no slice comes after this one
        state = pd.DataFrame({"line": names[first], "k": k, "s": at, **dict(zip(POINT, here.T)), "carry": True})
        return pd.concat([out, state], ignore_index=True)

    # Many short lines share a task; a bucket holds about LINES_BUCKET points.
    buckets = max(32, n_rows // LINES_BUCKET)
    state = None
    found = [kept.withColumn("_part", F.lit(0))]
    for start in range(0, max(longest, 1), slice_points):
        # One point of overlap lets a step end between two slices.
        part = work.where(F.col("pos").between(start, start + slice_points))
        if state is not None:
            part = lookup(part, state, ["line"], n_rows)
        done = cut(part.groupBy(F.pmod(F.xxhash64("line"), F.lit(buckets)).alias("_b")).applyInPandas(walk, schema), "walk")
        found.append(done.where(~F.col("carry")).select("line", "k", *POINT, F.lit(start).alias("_part")))
        state = done.where("carry").select("line", F.col("k").alias("c_k"), F.col("s").alias("c_s"),
                                           *[F.col(c).alias(f"c_{c}") for c in POINT])
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if longest > slice_points:
        # The end point may replace a point kept in an earlier slice: the later one stays.
        out = out.groupBy("line", "k").agg(F.max_by(F.struct(*POINT), "_part").alias("_p")).select("line", "k", "_p.*")
    return out.select("line", F.col("k").alias("pos"), *POINT)


def _nearest_of_line(asked: DataFrame, keys: list[str], cloud: DataFrame, line: str, pos: str) -> DataFrame:
    """The nearest point (cx, cy, cz) of its line for every place asked (x, y, z), the first on ties; adds ``pos`` and d_sq.

    A line of at most ``PACKED`` points travels as one row and each place meets it there, so no pairs are shuffled;
    longer lines, and those with a missing coordinate, go through cells over the space of all lines.
    """
    c, q = triple("cx", "cy", "cz"), triple("x", "y", "z")
    away = sub(q, c)
    d_sq = away[0] * away[0] + away[1] * away[1] + away[2] * away[2]
    bare = F.col("cx").isNull() | F.col("cy").isNull() | F.col("cz").isNull()
    size = cloud.groupBy(line).agg(F.count("*").alias("_n"), F.count_if(bare).alias("_bare"))
    long, tally = cut_counted(size.where((F.col("_n") > PACKED) | (F.col("_bare") > 0)).select(line), "long", n=F.count(F.lit(1)))
    asked_long, cloud_long, space = None, None, None
    if tally["n"]:
        space = cloud.agg(*[f(v) for f in (F.min, F.max) for v in c]).first()
        asked_long, cloud_long = asked.join(long, line, "left_semi"), cloud.join(long, line, "left_semi")
        asked, cloud = asked.join(long, line, "left_anti"), cloud.join(long, line, "left_anti")
    packed = cloud.groupBy(line).agg(F.collect_list(F.struct(pos, "cx", "cy", "cz")).alias("_points"))

    def met(p: Column) -> Column:
        x, y, z = (v - p[f"c{a}"] for a, v in zip("xyz", q))
        return F.struct((x * x + y * y + z * z).alias("d_sq"), p[pos].alias(pos))

    near = asked.join(packed, line).withColumn("_b", F.array_min(F.transform("_points", met)))
    near = near.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in asked.columns if c not in keys], "_b"), "_b").alias("_a"))
    out = [*keys, *[F.col(f"_a.{c}").alias(c) for c in asked.columns if c not in keys], F.col(f"_a._b.{pos}").alias(pos), F.col("_a._b.d_sq").alias("d_sq")]
    near = near.select(*out)
    if cloud_long is None:
        return near
    far = boxes.k_nearest(asked_long, keys, q, q, boxes.build(cloud_long, c, c, [line], space=space), 1, d_sq, [pos])
    return near.unionByName(far.select(*near.columns))


def closest_pairs(points: DataFrame, connections: DataFrame) -> DataFrame:
    """Closest pair of points of two lines per connection (parent, child), the first pair on ties."""
    asked = connections.join(points.select(F.col("line").alias("child"), F.col("pos").alias("child_pos"), *[
        F.col(a) for a in "xyz"]), "child")
    cloud = points.select(F.col("line").alias("parent"), F.col("pos").alias("parent_pos"), *[
        F.col(a).alias(f"c{a}") for a in "xyz"])
    near = _nearest_of_line(asked, ["parent", "child", "child_pos"], cloud, "parent", "parent_pos")
    best = F.min_by(F.struct("parent_pos", "child_pos", "d_sq"), F.struct("d_sq", "parent_pos", "child_pos"))
    pairs = near.groupBy("parent", "child").agg(best.alias("b"))
    return pairs.select("parent", "child", "b.parent_pos", "b.child_pos", F.sqrt("b.d_sq").alias("gap_mm"))


def _ends(points: DataFrame) -> DataFrame:
    spot = F.struct("x", "y", "z")
    return points.groupBy("line").agg(F.max("pos").alias("n"), F.min_by(spot, "pos").alias("a"), F.max_by(spot, "pos").alias("z"))


def _gap(u: str, v: str) -> Column:
    return norm(sub(triple("x", "y", "z", of=u), triple("x", "y", "z", of=v)))


def _flipped(points: DataFrame, which: DataFrame) -> DataFrame:
    """Lines of ``which`` (line, n, flip) with the marked ones reversed."""
    n = points.count()
    pos = F.when(F.col("flip"), F.col("n") + 1 - F.col("pos")).otherwise(F.col("pos"))
    return lookup(points, which, ["line"], n).withColumn("pos", pos.cast("int")).drop("n", "flip")


def oriented_to_reference(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines of ``pairs`` (line, reference) turned so that their start is the end nearer to the reference line."""
    ends = _ends(points)
    tips = pairs.join(ends, "line").select(
        "reference", "line", "n", F.inline(F.array(F.struct(F.lit(0).alias("tip"), "a.x", "a.y", "a.z"),
                                                   F.struct(F.lit(1).alias("tip"), "z.x", "z.y", "z.z"))))
    cloud = points.select(F.col("line").alias("reference"), F.col("pos").alias("rpos"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    near = _nearest_of_line(tips, ["reference", "line", "tip"], cloud, "reference", "rpos")
    flip = F.max(F.when(F.col("tip") == 1, F.col("d_sq"))) < F.max(F.when(F.col("tip") == 0, F.col("d_sq")))
    which = near.groupBy("line").agg(F.first("n").alias("n"), flip.alias("flip"))
    return _flipped(points, which)


def oriented_to_parent(points: DataFrame, connections: DataFrame) -> DataFrame:
    """Child lines turned so that they start at the end nearer to the last point of their parent."""
    ends = _ends(points)
    parent = ends.select(F.col("line").alias("parent"), F.col("z").alias("p_end"))
    which = connections.join(parent, "parent").join(ends.withColumnRenamed("line", "child"), "child").select(
        F.col("child").alias("line"), "n", (_gap("z", "p_end") < _gap("a", "p_end")).alias("flip"))
    return _flipped(points, which)


def joints(points: DataFrame, connections: DataFrame, tail_points: int = 2, extra_mm: float = 1.0) -> DataFrame:
    """Joint of every (parent, child): the closest pair of points, or the parent's last point when the pair lies
    within ``tail_points`` of it and joining there costs at most ``extra_mm`` more."""
    pairs = closest_pairs(points, connections)
    ends = _ends(points).select(F.col("line").alias("parent"), "n", F.col("z").alias("e"))
    near_end = pairs.join(ends, "parent").where(F.col("n") - F.col("parent_pos") <= tail_points)
    asked = near_end.select("parent", "child", "n", "e.x", "e.y", "e.z")
    cloud = points.select(F.col("line").alias("child"), F.col("pos").alias("end_child_pos"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    best = _nearest_of_line(asked, ["parent", "child"], cloud, "child", "end_child_pos")
    best = best.select("parent", "child", "n", "end_child_pos", F.sqrt("d_sq").alias("end_gap"))
    snap = F.coalesce(F.col("end_gap") <= F.col("gap_mm") + extra_mm, F.lit(False))
    return pairs.join(best, ["parent", "child"], "left").select(
        "parent", "child", F.when(snap, F.col("n")).otherwise(F.col("parent_pos")).alias("parent_index"),
        F.when(snap, F.col("end_child_pos")).otherwise(F.col("child_pos")).alias("child_index"),
        F.when(snap, F.col("end_gap")).otherwise(F.col("gap_mm")).alias("gap_mm"))


def assemble(points: DataFrame, roots: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Oriented, trimmed lines and their joints for trees of lines.

    ``roots`` is (tree, line, reference), ``connections`` (tree, parent, child).
    One round per level of connections: the children of all trees whose parent is
    in place are turned, joined and cut at their joint together.
    """
    points = cut(points, "lines")
    lost = (
        roots.select("line").union(roots.select(F.col("reference").alias("line")))
        .union(connections.select("parent")).union(connections.select("child")).distinct()
        .join(points.select("line").distinct(), "line", "left_anti")
    )
    if not lost.isEmpty():
        raise ValueError(f"missing lines, e.g. {[r[0] for r in lost.take(5)]}")
    from arborlake.operators.filters import trim_root_cap

    placed = cut(trim_root_cap(oriented_to_reference(points, roots)), "roots")
    placed = cut(placed.join(_ends(placed).select("line", F.lit(0).alias("level")), "line").withColumn(
        "pos", F.col("pos")), "roots")
    first = placed.groupBy("line").agg(F.min("pos").alias("_p"))
    done = cut(placed.join(first, "line").withColumn("pos", (F.col("pos") - F.col("_p") + 1).cast("int")).drop("_p"), "roots")
    made, waiting = None, connections
    for level in itertools.count(1):
        ready = waiting.join(done.select(F.col("line").alias("parent")).distinct(), "parent", "left_semi")
        ready, tally = cut_counted(ready, "ready", n=F.count("*"))
        if tally["n"] == 0:
            break
        kids = points.join(ready.select(F.col("child").alias("line")), "line", "left_semi")
        both = done.drop("level").unionByName(kids)
        turned = cut(oriented_to_parent(both, ready), "turned")
        joint = cut(joints(done.drop("level").unionByName(turned), ready).join(ready, ["parent", "child"]), "joints")
        trimmed = turned.join(joint.select(F.col("child").alias("line"), "child_index"), "line").where(
            F.col("pos") >= F.col("child_index"))
        trimmed = trimmed.withColumn("pos", (F.col("pos") - F.col("child_index") + 1).cast("int")).drop("child_index")
        done = cut(done.unionByName(trimmed.withColumn("level", F.lit(level))), "done")
        made = joint if made is None else made.unionByName(joint)
        waiting = cut(waiting.join(ready.select("child"), "child", "left_anti"), "waiting")
    if not waiting.isEmpty():
        raise ValueError(f"unresolved connections, e.g. {[tuple(r) for r in waiting.take(5)]}")
    return done, made


def tree_segments(points: DataFrame, tree_lines: DataFrame, joint: DataFrame | None) -> DataFrame:
    """Segments of whole trees of lines: ids run through the lines of a tree by level and name.

    ``tree_lines`` is (tree, line); the first segment of a child starts at its joint.
    """
    sized = points.groupBy("line").agg((F.max("pos") - 1).alias("m"), F.first("level").alias("level")).join(tree_lines, "line")
    w = Window.partitionBy("tree").orderBy("level", "line").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("tree", "line", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("_off"))
    n = points.count()
    segs = lookup(chained_segments(points), offsets, ["line"], n)
    own = F.col("_off") + F.col("id")
    if joint is None:
        return segs.select("tree", own.alias("id"), F.when(F.col("parent_id") > 0, own - 1).otherwise(F.lit(-1)).alias("parent_id"),
                           "px", "py", "pz", "dx", "dy", "dz", "radius_mm")
    spot = points.select(F.col("line").alias("parent"), F.col("pos").alias("parent_index"), F.struct("x", "y", "z").alias("at"))
    start = joint.join(spot, ["parent", "parent_index"]).join(
        offsets.select(F.col("line").alias("parent"), F.col("_off").alias("p_off")), "parent")
    start = start.select(F.col("child").alias("line"), "at", (F.col("p_off") + F.col("parent_index") - 1).alias("up"))
    first = F.col("id") == 1
    joined = lookup(segs, segs.select("line").distinct().join(start, "line", "left"), ["line"], n)
    parent = F.when(~first, own - 1).otherwise(F.coalesce("up", F.lit(-1)))
    moved = [F.when(first & F.col("at").isNotNull(), F.col(f"at.{a}")).otherwise(F.col(f"p{a}")).alias(f"p{a}") for a in "xyz"]
    return joined.select("tree", own.alias("id"), parent.alias("parent_id"), *moved, "dx", "dy", "dz", "radius_mm")
