"""Territories: cells of a domain shared out among trees."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.functions import domains, geometry as g
from arborlake.functions.vectors import clamp, dot, norm, sub, triple
from arborlake.operators import ranking, voxels
from arborlake.operators.spatial import end, place, start
from arborlake.plans import boxes
from arborlake.plans.cut import cut, cut_counted


def cells_of(spark: SparkSession, domain: domains.Domain, per_side: int = 20) -> tuple[DataFrame, voxels.Grid]:
    """Cells (i, j, k, x, y, z, inside) over the domain's box, cubes of a fixed number per longest side."""
    lo, hi = domain.bounds()
    size = max(b - a for a, b in zip(lo, hi)) / per_side
    dims = tuple(max(1, math.ceil((b - a) / size)) for a, b in zip(lo, hi))
    grid = voxels.Grid(tuple(float(v) for v in lo), (size,) * 3, dims)
    n = F.col("id")
    cells = spark.range(dims[0] * dims[1] * dims[2]).select(
        (n % dims[0] + 1).cast("int").alias("i"), (F.floor(n / dims[0]) % dims[1] + 1).cast("int").alias("j"),
        (F.floor(n / (dims[0] * dims[1])) + 1).cast("int").alias("k"))
    placed = cells.withColumns({a: o + (F.col(v) - 0.5) * size for a, v, o in zip("xyz", ("i", "j", "k"), lo)})
    return placed.withColumn("inside", domain.inside(place())), grid


def anchors(config: DataFrame, domain: domains.Domain, share: float = 0.35) -> DataFrame:
    """(tree, ax, ay, az): a place ahead of every root, pulled into the domain; the root itself without a direction."""
    lo, hi = domain.bounds()
    reach = share * max(b - a for a, b in zip(lo, hi))
    root, way = triple("x", "y", "z"), triple("dir_x", "dir_y", "dir_z")
    length = norm(way)
    ahead = tuple(r + reach * w / length for r, w in zip(root, way))
    safe = domain.project(ahead)
    return config.select("tree", *[F.when(length <= 1e-12, r).otherwise(s).alias(f"a{c}") for r, s, c in zip(root, safe, "xyz")])


# Share of the domain's size by which a bias moves for a share that is off by one, rounds, tolerance.
GAIN, ROUNDS, TOLERANCE = 0.35, 48, 0.02
FIRST, WIDER = 8, 4  # trees that are looked at for a cell to begin with, and how many times more where they do not settle it
CELL = ["i", "j", "k"]


def _candidates(cells: DataFrame, spots: DataFrame, anchor_index: boxes.BoxIndex, tree_index: boxes.BoxIndex | None, weight: float, k: int) -> DataFrame:
    """(cell, tree, s, known, bound): blends of distances to the trees that come near in anchor or in a segment.

    A tree with no segment among those found is at least as far as the last of these, which makes its ``s`` a lower
    bound (``known`` is false); ``bound`` is one for the trees that are not listed.
    """
    away = sub(place(), triple("ax", "ay", "az"))
    near = boxes.k_nearest(cells, CELL, place(), place(), anchor_index, k, dot(away, away), ["tree"])
    near = cut(near.select(*CELL, "x", "y", "z", "tree", "d_sq"), "anchors")
    last = lambda rows: F.when(F.count("*") == rows, F.sqrt(F.max("d_sq"))).otherwise(F.lit(math.inf))
    ends = near.groupBy(*CELL).agg(last(k).alias("_a"))
    if tree_index is None:
        return near.join(ends, CELL).select(*CELL, "tree", F.sqrt("d_sq").alias("s"), F.lit(True).alias("known"), F.col("_a").alias("bound"))
    close = boxes.k_nearest(cells, CELL, place(), place(), tree_index, FIRST * k, g.point_segment_sq(place(), start(), end()), ["tree", "id"])
    close = cut(close.select(*CELL, "x", "y", "z", "tree", "d_sq"), "segments")
    reach = close.groupBy(*CELL).agg(last(FIRST * k).alias("_t"))
    seen = close.groupBy(*CELL, "x", "y", "z", "tree").agg(F.sqrt(F.min("d_sq")).alias("t"))
    listed = near.select(*CELL, "x", "y", "z", "tree").withColumn("t", F.lit(None).cast("double")).unionByName(seen)
    listed = listed.groupBy(*CELL, "x", "y", "z", "tree").agg(F.max("t").alias("t")).join(spots, "tree")
    met = listed.join(ends, CELL).join(reach, CELL)
    own = norm(sub(place(), triple("ax", "ay", "az")))
    blend = lambda anchor, tree: (1 - weight) * anchor + weight * tree
    # Where all segments were found, a tree that is not among them has none.
    return met.select(*CELL, "tree", blend(own, F.coalesce("t", "_t")).alias("s"), (F.col("t").isNotNull() | (F.col("_t") == math.inf)).alias("known"), blend(F.col("_a"), F.col("_t")).alias("bound"))


def _owners(listed: DataFrame, biases: DataFrame, highest: float) -> DataFrame:
    """(cell, owner, sure): the listed tree with the smallest blend less its bias; no other tree can come before it."""
    v = F.col("s") - F.col("bias")
    scored = listed.join(biases, "tree").withColumns({"_v": F.struct(v.alias("v"), "tree"), "_open": F.when(~F.col("known"), v)})
    best = scored.groupBy(*CELL).agg(F.min(F.when(F.col("known"), F.col("_v"))).alias("_v"), F.min("_open").alias("_open"), (F.first("bound") - highest).alias("_rest"))
    others = F.least("_open", "_rest")  # nulls are skipped
    return best.select(*CELL, F.col("_v.tree").alias("owner"), F.coalesce((F.col("_v.v") < others) | (others == math.inf), F.lit(False)).alias("sure"))


def territories(config: DataFrame, segs: DataFrame | None, domain: domains.Domain, tree_weight: float = 1.0, per_side: int = 20,
                rounds: int = ROUNDS, tolerance: float = TOLERANCE, clean: bool = False, min_voxels: int = 16) -> tuple[DataFrame, voxels.Grid]:
    """Owner of every cell: smallest blend of anchor distance and tree distance, less a bias per tree.

    The biases are moved until the shares of the inside cells meet the targets.  A cell knows a few near trees and how
    near any other can be; while the biases leave its owner open it looks farther.  Biases are a table, one row a tree,
    so the plans do not depend on the number of trees.
    """
    spark = config.sparkSession
    cells, grid = cells_of(spark, domain, per_side)
    cells = cut(cells, "cells")
    targets = cut(ranking.shares(config, [], "fraction").select("tree", F.col("share").alias("target")), "targets")
    weight = 0.0 if segs is None else tree_weight
    spots = cut(anchors(config, domain), "spots")
    at = triple("ax", "ay", "az")
    anchor_index = boxes.build(spots, at, at)
    tree_index = None
    if weight > 0:
        lo = tuple(F.least(a, b) for a, b in zip(start(), end()))
        hi = tuple(F.greatest(a, b) for a, b in zip(start(), end()))
        tree_index = boxes.build(segs.select("tree", "id", "px", "py", "pz", "dx", "dy", "dz").join(targets.select("tree"), "tree", "left_semi"), lo, hi)
    looked = FIRST
    listed = cut(_candidates(cells, spots, anchor_index, tree_index, weight, looked), "listed")
    biases, tally = cut_counted(targets.select("tree", F.lit(0.0).alias("bias")), "biases", high=F.max("bias"), trees=F.count("*"))
    n_trees = tally["trees"]
    gain = GAIN * grid.spacing[0] * max(grid.dims)

    for turn in range(rounds + 1):
        owned, seen = cut_counted(_owners(listed, biases, tally["high"] or 0.0), "owners", open=F.count_if(~F.col("sure")))
        while seen["open"]:
            looked *= WIDER
            asked = cells.join(owned.where("NOT sure").select(*CELL), CELL, "left_semi")
            wider = cut(_candidates(asked, spots, anchor_index, tree_index, weight, looked), "wider")
            listed = cut(listed.join(asked.select(*CELL), CELL, "left_anti").unionByName(wider), "listed")
            owned, seen = cut_counted(_owners(listed, biases, tally["high"] or 0.0), "owners", open=F.count_if(~F.col("sure")))
        if turn == rounds or n_trees < 2:
            break
        inside = owned.join(cells.where("inside").select(*CELL), CELL, "left_semi")
        counts = inside.groupBy(F.col("owner").alias("tree")).agg(F.count("*").alias("n"))
        whole = inside.agg(F.count("*")).scalar()
        moved = targets.join(counts.withColumn("_actual", F.col("n") / whole), "tree", "left").join(biases, "tree")
        off = F.col("target") - F.coalesce("_actual", F.lit(0.0))
        moved, tally = cut_counted(moved.select("tree", off.alias("off"), (F.col("bias") + gain * off).alias("bias")), "moved", most=F.max(F.abs("off")), mean=F.avg("bias"))
        if (tally["most"] or 0.0) <= tolerance or not inside.take(1):
            break
        biases, tally = cut_counted(moved.select("tree", (F.col("bias") - tally["mean"]).alias("bias")), "biases", high=F.max("bias"))
    out = cells.join(owned.select(*CELL, "owner"), CELL)
    if clean:
        out = voxels.clean_islands(out.where("inside"), "owner", min_voxels).unionByName(out.where("NOT inside"), allowMissingColumns=True)
    return out.select("i", "j", "k", "x", "y", "z", "inside", "owner"), grid


def cell_of(q, grid: voxels.Grid) -> list[Column]:
    """Cell indices of a place, kept inside the grid."""
    return [clamp(F.floor((v - o) / s) + 1, 1, n).cast("int") for v, o, s, n in zip(q, grid.origin, grid.spacing, grid.dims)]


def owner_of(points: DataFrame, owned: DataFrame, grid: voxels.Grid) -> DataFrame:
    """Adds the owner of the cell a point lies in."""
    at = points.withColumns(dict(zip(("i", "j", "k"), cell_of(place(), grid))))
    return at.join(owned.select("i", "j", "k", "owner"), ["i", "j", "k"]).drop("i", "j", "k")


def diagnostics(owned: DataFrame, segs: DataFrame) -> DataFrame:
    """Per owner: share of the inside cells, and share of its cells whose nearest tree is another."""
    from arborlake.operators.spatial import nearest_tree

    inside = owned.where("inside").withColumn("qid", F.struct("i", "j", "k"))
    near = nearest_tree(inside.select("qid", "x", "y", "z"), segs)
    met = inside.select("qid", "owner").join(near, "qid")
    total = met.select(F.count("*")).scalar()
    return met.groupBy("owner").agg(F.count("*").alias("n"), F.avg((F.col("nearest_tree") != F.col("owner")).cast("double")).alias("mismatch")).withColumn(
        "share", F.col("n") / total)
