"""Searches of few queries, items that share spots, samples of many surfaces, and bit filters of small blocks."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions.vectors import dot, sub, triple
from arborlake.llm import decontamination
from arborlake.operators import spatial, surfaces as N
from arborlake.plans import boxes
from arborlake.sources import tables


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("crowd", [1, boxes.CROWD])
def test_few_and_many_queries_find_the_same(spark, monkeypatch, few, crowd):
    monkeypatch.setattr(boxes, "SMALL_LEVEL", 0)
    monkeypatch.setattr(boxes, "FEW_QUERIES", few)
    rng = random.Random(5)
    spots = [(rng.random(), rng.random(), rng.random()) for _ in range(300)]
    items = [(i, *spots[i % 300]) for i in range(1500)]
    asked = [(q, rng.random(), rng.random(), rng.random()) for q in range(12)]
    s, p = triple("sx", "sy", "sz"), triple("x", "y", "z")
    index = boxes.build(spark.createDataFrame(items, "id long, sx double, sy double, sz double"), s, s, leaf_rows=4, crowd=crowd)
    away = sub(p, s)
    found = boxes.k_nearest(spark.createDataFrame(asked, "qid long, x double, y double, z double"), ["qid"], p, p, index, 2, dot(away, away), ["id"])
    got = sorted((r.qid, r.rank, r.id) for r in found.collect())
    want = [(q[0], n + 1, i[0]) for q in asked for n, i in enumerate(sorted(items, key=lambda i: (math.dist(q[1:], i[1:]), i[0]))[:2])]
    assert got == want


def test_levels_end_where_items_share_a_spot(spark):
    rng = random.Random(6)
    spots = [(rng.random(), rng.random(), rng.random()) for _ in range(100)]
    items = spark.createDataFrame([(i, *spots[i % 100]) for i in range(6000)], "id long, sx double, sy double, sz double")
    s = triple("sx", "sy", "sz")
    index = boxes.build(items, s, s, leaf_rows=20)
    assert index.crowded and len(index.levels) <= 6


def test_best_junction_against_brute_force(spark):
    rng = random.Random(7)
    two = [("T", i, *(10 * rng.random() for _ in range(3)), rng.choice([0.01, 0.2, 0.9])) for i in range(200)] + [("U", 0, 1.0, 1.0, 1.0, 0.5), ("T", 999, 1.0, 1.0, 1.0, 0.5)]
    asked = [(q, *(14 * rng.random() for _ in range(3))) for q in range(30)] + [(30, 1.0, 1.0, 1.0), (31, 500.0, 0.0, 0.0)]
    got = {r.qid: (r.tree, r.id) for r in spatial.merge_candidates(
        spark.createDataFrame(asked, "qid long, x double, y double, z double"),
        spark.createDataFrame(two, "tree string, id long, dx double, dy double, dz double, radius_mm double")).collect()}
    want = {}
    for q, *at in asked:
        chi = [(-(math.inf if math.dist(at, j[2:5]) == 0 else 2 * math.pi * j[5] / math.dist(at, j[2:5])), j[0], j[1]) for j in two]
        if -min(chi)[0] > 0.83:
            want[q] = min(chi)[1:]
    assert got == want and 31 not in got


def test_samples_of_many_surfaces_share_files(spark, tmp_path):
    rows = [(name, j, i, j + i / 10, -1.0 * i, 1e-5, 0.0, 0.6, 0.8) for name in ("a,b", "007", "tube %s", "ü\n") for j in range(2) for i in range(3)]
    samples = spark.createDataFrame(rows, "surface string, j int, i int, x double, y double, z double, nx double, ny double, nz double")
    paths = f"{tmp_path}/points", f"{tmp_path}/normals"
    tables.write_sampled_surface(samples, *paths)
    assert not [f for p in paths for f in os.listdir(p) if os.path.isdir(f"{p}/{f}")]
    both = tables.surface_points(*[tables.read_sampled_surface(spark, p) for p in paths])
    assert sorted(tuple(r) for r in both.select("surface", "id", "x", "y", "z", "ny").collect()) == sorted((r[0], r[1] * 3 + r[2] + 1, *r[3:6], r[7]) for r in rows)


@pytest.mark.parametrize("small", [256, 0])
def test_a_short_table_of_surfaces_is_sampled_by_many_tasks(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL_NET", small)
    at = spark.createDataFrame([(f"s{k}", 4, 5) for k in range(40)], "surface string, m int, n int").coalesce(1)
    knots = at.select("surface", F.inline(F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(i).alias("idx"), F.lit(v).alias("value"))
                                                    for d, n, p in (("u", 5, 4), ("v", 4, 3)) for i, v in enumerate(N.open_uniform_knots(n, p))])))
    net = at.select("surface", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(5)))).select(
        "surface", "row", "col", *[F.col(c).cast("double").alias(a) for a, c in (("x", "col"), ("y", "row"))], F.lit(0.0).alias("z"))
    made = N.sample(at, knots, net, F.lit(3), F.lit(2))
    assert "RepartitionByExpression" in made._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    rows = {(r.surface, r.j, r.i): (r.x, r.y, r.nz) for r in made.collect()}
    assert len(rows) == 240 and rows["s3", 1, 2] == pytest.approx((5.0, 4.0, 1.0)) and rows["s0", 0, 1] == pytest.approx((3.0, 1.0, 1.0))


def test_bit_filters_are_as_large_as_their_block():
    values = np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64)
    bits = decontamination._bits(values)
    assert len(bits) <= 16384 and decontamination._within(values, np.unique(values), bits).all()
    other = values + np.uint64(1)
    assert (decontamination._within(other, np.unique(values), bits) == np.isin(other, values)).all()
