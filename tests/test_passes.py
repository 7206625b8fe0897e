"""Searches in one pass, whichever side travels, against loops; nothing of them is written."""

import math
import random

import numpy as np
import pytest

from arborlake.functions import flow
from arborlake.operators import spatial
from arborlake.plans import boxes, passes

SURFACE = "surface string, id bigint, x double, y double, z double, nx double, ny double, nz double"
TWIG = "tree string, id bigint, px double, py double, pz double, dx double, dy double, dz double, radius_mm double, length_mm double"
SIDES = [(10**6, 10**6), (0, 10**6)]


@pytest.fixture(params=SIDES, ids=["items travel", "queries travel"])
def side(request, monkeypatch):
    held, places = request.param
    for name, value in (("HELD", held), ("PLACES", places), ("CHUNK", 64), ("ASKED", 5), ("FRONT", 40), ("SENT", 30)):
        monkeypatch.setattr(passes, name, value)
    monkeypatch.setattr(boxes, "build", lambda *a, **b: pytest.fail("cells were written"))


def _asked(spark, n, seed):
    rng = random.Random(seed)
    rows = [(q, *(10 * rng.random() for _ in range(3))) for q in range(n)]
    return rows, spark.createDataFrame(rows, "qid bigint, x double, y double, z double")


def _segments(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = [10 * rng.random() for _ in range(3)]
        d = [v + rng.uniform(-1, 1) for v in p]
        rows.append((rng.choice("TU"), i, *p, *d, rng.uniform(0.004, 0.06), math.dist(p, d)))
    return [*rows, *(("A", r[1], *r[2:]) for r in rows[:40])]  # on one spot with others


def _gap(q, s):
    p, d = np.array(s[2:5]), np.array(s[5:8])
    t = min(max(float(np.dot(np.array(q) - p, d - p) / np.dot(d - p, d - p)), 0.0), 1.0)
    return float(np.linalg.norm(np.array(q) - (p + t * (d - p))))


def test_nearest_samples_of_two_surfaces(spark, side):
    rng = random.Random(3)
    rows = [(rng.choice(["outer", "cavity"]), i, *(10 * rng.random() for _ in range(3)), 0.0, 0.6, 0.8) for i in range(300)]
    rows += [(s, i + 1000, *v) for s, i, *v in rows[:100]] + [(s, i - 1000, *v) for s, i, *v in rows[100:200]]  # copies: the first id is taken
    rows += [("outer", -5000, None, None, None, None, None, None), ("lost", 7, None, None, None, None, None, None), ("lost", 6, None, None, None, None, None, None), (None, 1, *rows[0][2:])]
    asked, _ = _asked(spark, 25, 4)
    wanted = [(*q, s) for q in asked for s in ("outer", "cavity", "lost", "none")] + [(99, None, None, None, "outer"), (98, 1.0, 2.0, 3.0, None)]
    got = spatial.nearest_surface_point(spark.createDataFrame(wanted, "qid bigint, x double, y double, z double, surface string"),
                                        spark.createDataFrame(rows, SURFACE).repartition(3)).collect()
    want = {(99, "outer"): (-5000, None)}
    for q, *at, s in wanted[:-2]:
        mine = [r for r in rows if r[0] == s]
        near = [(math.dist(at, r[2:5]), r[1]) for r in mine if r[2] is not None]
        if mine:
            want[q, s] = min(near)[::-1] if near else (6, None)
    assert {(r.qid, r.surface): (r.sid, r.d_sq and pytest.approx(math.sqrt(r.d_sq))) for r in got} == want and len(got) == len(want)


def test_places_pushed_to_a_surface_write_no_samples(spark, side):
    rows = [("s", i, math.cos(i), math.sin(i), i / 100 - 1, math.cos(i), math.sin(i), 0.0) for i in range(200)]
    asked = spark.createDataFrame([(1, "s", 3.0, 0.0, 0.0), (2, "s", 0.1, 0.0, 0.0)], "qid bigint, surface string, x double, y double, z double")
    back = {r.qid: (r.x, r.y) for r in spatial.project_to_surface(asked, spark.createDataFrame(rows, SURFACE)).collect()}
    assert math.hypot(*back[1]) < 1.2 and back[2] == (0.1, 0.0)


def test_segments_in_range_of_places(spark, side):
    rows = _segments(200, 5)
    asked, points = _asked(spark, 20, 6)
    lost = spark.createDataFrame([("T", 9000, None, *[1.0] * 7), ("T", 9001, *[1.0] * 6, None, 1.0)], TWIG)
    got = spatial.segments_in_range(points.unionByName(spark.createDataFrame([(77, None, 1.0, 1.0)], points.schema)),
                                    spark.createDataFrame(rows, TWIG).repartition(3).unionByName(lost), 2.0)
    found = sorted((r.qid, r.tree, r.id) for r in got.collect())
    ends = [*rows, ("T", 9001, *[1.0] * 3, *[1.0 + 1e-9] * 3)]
    assert found == sorted((q, s[0], s[1]) for q, *at in asked for s in ends if _gap(at, s) <= 2.0) and found


def test_best_connections_of_places(spark, side):
    rows = _segments(200, 7)
    asked, points = _asked(spark, 20, 8)
    lost = spark.createDataFrame([("T", 9000, *[5.0] * 6, None, 0.0)], TWIG)
    got = {r.qid: r for r in spatial.best_connection(points, spark.createDataFrame(rows, TWIG).repartition(3).unionByName(lost), flow.GAMMA).collect()}
    share, phi = 2 ** (-1 / flow.GAMMA), (5**0.5 - 1) / 2

    def cost(at, s, t):
        p, d, r, size = np.array(s[2:5]), np.array(s[5:8]), s[8], s[9]
        return r * t * size + share * r * (1 - t) * size + share * r * float(np.linalg.norm(p + t * (d - p) - np.array(at)))

    def best(at, s):
        a, b = 0.01, 0.99
        for _ in range(20):
            left, right = b - phi * (b - a), a + phi * (b - a)
            a, b = (a, right) if cost(at, s, left) < cost(at, s, right) else (left, b)
        return cost(at, s, (a + b) / 2)

    for q, *at in asked:
        least, tree, i = min((round(best(at, s), 12), s[0], s[1]) for s in rows)
        assert (got[q].tree, got[q].id) == (tree, i) and got[q].cost == pytest.approx(least)
    assert len(got) == 20


def test_many_of_both_sides_go_through_cells(spark, monkeypatch):
    monkeypatch.setattr(passes, "HELD", 0)
    monkeypatch.setattr(passes, "PLACES", 0)
    rows, (asked, points) = _segments(60, 9), _asked(spark, 6, 10)
    found = sorted((r.qid, r.tree, r.id) for r in spatial.segments_in_range(points, spark.createDataFrame(rows, TWIG), 2.0).collect())
    assert found == sorted((q, s[0], s[1]) for q, *at in asked for s in rows if _gap(at, s) <= 2.0) and found


def test_places_drawn_in_a_shell_meet_its_samples_without_cells(spark, side):
    from arborlake.operators import surfaces as N

    ball = [(s, k, *(r * v for v in at), *at) for s, r in (("outer", 5.0), ("cavity", 2.0)) for k in range(400)
            for z in [k / 200 - 0.9975] for at in [(math.sqrt(1 - z * z) * math.cos(2.4 * k), math.sqrt(1 - z * z) * math.sin(2.4 * k), z)]]
    inside, volume = N.interior_points(spark.createDataFrame(ball, SURFACE), "outer", ["cavity"], 40, 300, 3)
    rows = inside.withColumn("volume", volume).collect()
    assert len({r.qid for r in rows}) == len(rows) == 40 and rows[0].volume == pytest.approx(4 / 3 * math.pi * (125 - 8), rel=0.2)
    assert all(1.7 < math.dist((r.x, r.y, r.z), (0, 0, 0)) < 5.1 and r.shell_sd <= 0 for r in rows)
