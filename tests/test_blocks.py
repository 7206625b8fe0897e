"""Searches in blocks: against brute force, with small blocks, spots shared by many, small and large scopes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import lines, spatial
from arborlake.plans import blocks, boxes

SEG = "tree string, id long, parent_id long, px double, py double, pz double, dx double, dy double, dz double, radius_mm double"


def _segs(spark, n, trees="ABC", seed=1, same=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = [rng.random() * 10 for _ in range(3)]
        rows.append((rng.choice(trees), i + 1, i // 2 if i else -1, *p, *[v + rng.random() - 0.5 for v in p], 0.1))
    rows += [("A", n + 1 + i, 1, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 0.1) for i in range(same)]
    return rows, spark.createDataFrame(rows, SEG)


def _to(q, p, d):
    return math.sqrt(blocks.point_segment_sq(*(np.array(v, float)[:, None] for v in (q, p, d)))[0])


@pytest.mark.parametrize("block", [40, 1 << 15])
def test_collisions_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows, segs = _segs(spark, 300, same=150)
    got = {(r.tree, r.id): r.distance for r in spatial.collisions(segs, 1.0).collect()}
    want = {}
    for r in rows:
        d = min(_to(r[6:9], s[3:6], s[6:9]) for s in rows if s[0] != r[0])
        if d < 1.0:
            want[r[0], r[1]] = d
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("block", [40, 1 << 15])
def test_nearest_other_end_in_large_and_small_trees(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows, segs = _segs(spark, 400, trees="AAAABBBBCDEFGH", seed=2, same=120)
    rows += [("lone", 1, -1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.1)]
    got = {(r.tree, r.id): (r.nearest, r.weight) for r in spatial.nearest_other_terminal(spark.createDataFrame(rows, SEG)).collect()}
    for r in rows:
        others = [math.dist(r[6:9], s[6:9]) for s in rows if s[0] == r[0] and s[1] != r[1]]
        assert got[r[0], r[1]][0] == (pytest.approx(min(others), abs=1e-12) if others else None)
    assert got["lone", 1] == (None, 1.0)


@pytest.mark.parametrize("block", [40, 1 << 15])
def test_intersections_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows, segs = _segs(spark, 150, seed=3)
    rows += [("B", 900 + i, 1, 5.0 + i / 100, 5.0, 5.0, 5.5, 5.0, 5.0, 0.1) for i in range(60)]
    up = {(r[0], r[1]): r[2] for r in rows}

    def line(key, hops=8):
        out = [key[1]]
        while len(out) <= hops and (key[0], up[key[0], out[-1]]) in up:
            out.append(up[key[0], out[-1]])
        return out

    def near(a, b):
        x, y = line(a), line(b)
        return a[0] == b[0] and min((i + y.index(v) for i, v in enumerate(x) if v in y), default=99) <= 8

    got = {(r.a_tree, r.a_id, r.b_tree, r.b_id) for r in spatial.intersections(spark.createDataFrame(rows, SEG), 0.6).collect()}
    ends = np.array([r[3:9] for r in rows]).T
    want = set()
    for i, a in enumerate(rows):
        d = blocks.segment_segment_sq(np.repeat(ends[:3, [i]], len(rows), 1), np.repeat(ends[3:, [i]], len(rows), 1), ends[:3], ends[3:])
        want |= {(a[0], a[1], b[0], b[1]) for j, b in enumerate(rows) if a[:2] < b[:2] and d[j] < 0.36 and not near(a[:2], b[:2])}
    assert got == want


def test_rows_shuffled_follow_the_items(spark, monkeypatch):
    """A query leaves its block only for blocks nearer than what it has found."""
    monkeypatch.setattr(blocks, "BLOCK", 64)
    rng = random.Random(4)
    rows = [(i, i, *[rng.random() * 100 for _ in range(3)]) for i in range(4000)]
    items = spark.createDataFrame(rows, "id long, own long, x double, y double, z double").select(
        "id", "own", *[F.col(c).alias(f"{k}{c}") for k in "pd" for c in "xyz"])
    held = blocks.Blocks(items)
    assert held.items.groupBy("_b").count().agg(F.max("count")).first()[0] <= 128
    asked = held.items.withColumn("d_sq", F.lit(9.0))
    # Blocks that straddle a fold of the curve have large boxes; all the same, few of the 62 others are met.
    assert held.routed(asked, ("dx", "dy", "dz"), "d_sq", True).count() < 62 * len(rows) / 8


@pytest.mark.parametrize("packed", [3, 1 << 10])
def test_closest_pairs_of_short_and_long_lines(spark, monkeypatch, packed):
    """Short lines travel whole: no cells are built for them."""
    monkeypatch.setattr(lines, "PACKED", packed)
    if packed > 6:
        monkeypatch.setattr(boxes, "build", None)
    rng = random.Random(5)
    spots = {(n, p): [rng.randrange(4) for _ in range(3)] for n in range(12) for p in range(1, 2 + n % 6)}
    asked = [(n, (n + k) % 12) for n in range(12) for k in (1, 5)]
    points = spark.createDataFrame([(n, p, *map(float, at)) for (n, p), at in spots.items()], "line long, pos int, x double, y double, z double")
    got = {(r.parent, r.child): (r.parent_pos, r.child_pos, r.gap_mm) for r in lines.closest_pairs(points, spark.createDataFrame(asked, "parent long, child long")).collect()}
    for a, b in asked:
        d, i, j = min((math.dist(u, v), i, j) for (n, i), u in spots.items() if n == a for (m, j), v in spots.items() if m == b)
        assert got[a, b] == (i, j, pytest.approx(d))


def test_ancestors_and_blocks_leave_one_table_each(spark, monkeypatch):
    """Rounds of the ancestor lists and tables that blocks were made from are dropped; an item is sent to its block once."""
    from arborlake.operators import trees
    from arborlake.plans import cut

    written, dropped = [], []
    whole, drop = cut.cut, cut.discard
    for module in (blocks, trees):
        monkeypatch.setattr(module, "cut", lambda df, label="cut": written.append(label) or whole(df, label))
        monkeypatch.setattr(module, "discard", lambda *t: dropped.extend(x for x in t if getattr(x, "cut_path", None)) or drop(*t))
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rows = [("T", i, i // 2 or -1, float(i % 9), 0.3 * i, 0.0, i % 9 + 1.0, 0.3 * i, 0.5, 0.1) for i in range(1, 100)]
    segs = spark.createDataFrame(rows, "tree string, id bigint, parent_id bigint, px double, py double, pz double, dx double, dy double, dz double, radius_mm double")
    assert {r.id: r.up for r in trees.recent_ancestors(segs, 4).collect()}[99] == [99, 49, 24, 12, 6]
    met = spatial.intersections(segs, 0.6)
    assert met.count() > 0 and "CoGroup" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(written) == sorted(["ancestors"] * 7 + ["numbers", "items", "blocks"]) and len(dropped) == 6
