"""Weighted partition of cells among many trees against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import domains
from arborlake.operators import territory

CONFIG = "tree string, x double, y double, z double, radius double, dir_x double, dir_y double, dir_z double, target int, fraction double"
BALL = domains.Sphere((0.0, 0.0, 0.0), 10.0)


def forest_of(n, seed):
    r = random.Random(seed)
    config = [(f"T{i:05d}", *[r.uniform(-6, 6) for _ in range(3)], 1.0, *([0.0] * 3 if i % 4 == 0 else [r.uniform(-1, 1) for _ in range(3)]), 10, r.random() ** 3) for i in range(n)]
    segs = []
    for i in range(n):
        if i % 7 == 3:
            continue  # a tree without segments
        for k in range(r.randint(1, 5)):
            p = [r.uniform(-8, 8) for _ in range(3)]
            segs.append((f"T{i:05d}", k + 1, -1 if k == 0 else k, *p, *[c + r.uniform(-2, 2) for c in p], 0.1))
    return config, segs


def brute(config, segs, weight, per_side, rounds):
    size = 20.0 / per_side
    cells = {(i + 1, j + 1, k + 1): np.array([-10 + (v + 0.5) * size for v in (i, j, k)]) for i in range(per_side) for j in range(per_side) for k in range(per_side)}
    keys, q = list(cells), np.array(list(cells.values()))
    names = sorted(c[0] for c in config)
    rows = {c[0]: c for c in config}
    total = sum(c[9] for c in config)
    target = np.array([rows[n][9] / total for n in names])
    score = np.empty((len(q), len(names)))
    for t, n in enumerate(names):
        root, way = np.array(rows[n][1:4]), np.array(rows[n][5:8])
        spot = root
        if np.linalg.norm(way) > 1e-12:
            spot = root + territory.GAIN * 20 * way / np.linalg.norm(way)
            spot = spot if np.linalg.norm(spot) <= 10 else spot * 10 / np.linalg.norm(spot)
        near = np.full(len(q), math.inf)
        for s in segs:
            if s[0] == n:
                p, d = np.array(s[3:6]), np.array(s[6:9])
                u = np.clip(((q - p) @ (d - p)) / ((d - p) @ (d - p)), 0, 1)
                near = np.minimum(near, np.linalg.norm(q - p - u[:, None] * (d - p), axis=1))
        score[:, t] = (1 - weight) * np.linalg.norm(q - spot, axis=1) + (weight * near if weight else 0)
    inside, bias = (q**2).sum(1) <= 100, np.zeros(len(names))
    for _ in range(rounds):
        own = (score - bias).argmin(1)
        off = target - np.bincount(own[inside], minlength=len(names)) / inside.sum()
        if np.abs(off).max() <= territory.TOLERANCE:
            break
        bias = bias + territory.GAIN * 20 * off
        bias -= bias.mean()
    own = (score - bias).argmin(1)
    return {k: names[o] for k, o in zip(keys, own)}


@pytest.mark.parametrize("weight", [0.0, 0.5])
def test_owners_of_cells_against_all_pairs(spark, make, monkeypatch, weight):
    config, segs = forest_of(16, 3)
    monkeypatch.setattr(territory, "FIRST", 2)  # so that cells have to look farther
    looked = []
    plain = territory._candidates
    monkeypatch.setattr(territory, "_candidates", lambda *a: looked.append(a[-1]) or plain(*a))
    table = spark.createDataFrame(config, CONFIG)
    forest = None if weight == 0 else spark.createDataFrame(segs, "tree string, id long, parent_id long, px double, py double, pz double, dx double, dy double, dz double, radius_mm double")
    owned, _ = territory.territories(table, forest, BALL, tree_weight=weight, per_side=6, rounds=3)
    got = {(r["i"], r["j"], r["k"]): r["owner"] for r in owned.collect()}
    want = brute(config, segs, weight, 6, 3)
    assert got == want and len(looked) > 1


def test_ten_thousand_trees_have_the_plans_of_ten(spark):
    size = {}
    for n in (10, 10_000):
        table = spark.createDataFrame(forest_of(n, 5)[0], CONFIG)
        owned, _ = territory.territories(table, None, BALL, per_side=16, rounds=1)
        size[n] = len(owned._jdf.queryExecution().toString().split("\n"))
        assert owned.count() == 16**3 and owned.where("owner IS NULL").count() == 0
    assert size[10_000] == size[10]
