"""Runs of single children: contraction, delays along them, rows placed along them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import growth, series as S
from arborlake.plans.runs import single_runs


def jobs_of(spark, work):
    """Number of jobs that ``work`` starts."""
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setJobGroup("other", "not counted")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def chain_of(make, n, tree="T"):
    return make([(i + 1, i if i else -1, float(i), 0.0, 0.0, i + 1.0, 0.0, 0.0, 0.1) for i in range(n)], tree)


def mixed_tree(n, seed):
    """(id, parent): half of the rows hang on the row before, the rest anywhere."""
    r = random.Random(seed)
    return [(1, -1)] + [(i, i - 1 if r.random() < 0.6 else r.randint(1, i - 1)) for i in range(2, n + 1)]


def brute_runs(edges, longest):
    kids, up = {}, dict(edges)
    for i, p in edges:
        kids.setdefault(p, []).append(i)
    out = {}
    for i, p in edges:  # parents have smaller ids
        if p > 0 and len(kids[p]) == 1:
            run, pos, level = out[p][0], out[p][1] + 1, out[p][3]
            piece = (pos - 1) // longest
            out[i] = (run, pos, piece, level + (piece > out[p][2]))
        else:
            out[i] = (i, 1, 0, 0 if p < 0 else out[p][3] + 1)
    return out


@pytest.mark.parametrize("longest", [100_000, 3])
def test_runs_and_their_levels(spark, make, longest):
    edges = mixed_tree(300, 4)
    segs = make([(i, p, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1) for i, p in edges])
    segs = segs.unionByName(make([(900, 901, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1), (901, 900, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1), (902, 77_777, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1)]))
    rows, levels = single_runs(segs, longest=longest)
    got = {r["id"]: (r["run"], r["pos"], r["piece"], r["level"]) for r in rows.where("id < 900").collect()}
    want = brute_runs(edges, longest)
    assert got == want and levels == 1 + max(v[3] for v in want.values())
    at = {r["id"]: r for r in rows.collect()}
    last = {}
    for i, (run, pos, piece, _) in want.items():
        if pos > last.get((run, piece), (0, 0))[0]:
            last[run, piece] = pos, i
    for i, p in edges:
        r = at[i]
        if p > 0 and want[p][:1] + want[p][2:3] != want[i][:1] + want[i][2:3]:
            assert last[r["up_run"], r["up_piece"]][1] == p


def brute_delays(edges, tau, curve, dt):
    out, n = {}, len(curve)
    for i, p in edges:
        inlet = curve if p < 0 else out[p][1]
        outlet = []
        for k in range(n):
            pos = k - tau[i] / dt
            lo, hi = math.floor(pos), math.ceil(pos)
            outlet.append(0.0 if pos < 0 else inlet[lo] if lo == hi else (1 - (pos - lo)) * inlet[lo] + (pos - lo) * inlet[hi])
        content = [0.0]
        for k in range(n - 1):
            content.append(max(content[-1] + dt * (inlet[k] - outlet[k]) / tau[i], 0.0))
        out[i] = (inlet, outlet, content)
    return out


@pytest.mark.parametrize("longest", [100_000, 2])
def test_delays_along_runs_against_a_walk(spark, make, monkeypatch, longest):
    edges = mixed_tree(120, 7)
    segs = make([(i, p, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1) for i, p in edges]).unionByName(make([(1, -1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1)], "short"))
    tau = {i: 0.05 + (i * 7 % 13) / 40 for i, _ in edges}
    curve = [math.sin(k / 3) + 1 for k in range(50)]
    inputs = spark.createDataFrame([("T", curve), ("short", [1.0, 2.0, 3.0])], "tree string, curve array<double>")
    monkeypatch.setattr(S, "single_runs", lambda *a: single_runs(*a, longest=longest))
    monkeypatch.setattr(S, "CELLS", 200)
    wide = S.delay_propagation(segs, 0.05 + (F.col("id") * 7 % 13) / 40, inputs, 0.1)
    got = {(r["tree"], r["id"]): r for r in wide.collect()}
    want = brute_delays(edges, tau, curve, 0.1)
    assert len(got) == 121 and len(got["short", 1]["outlet"]) == 3
    for i, _ in edges:
        for name, values in zip(("inlet", "outlet", "content"), want[i]):
            assert np.allclose(got["T", i][name], values, atol=1e-9), (i, name)


def test_a_long_chain_takes_few_more_jobs_than_a_short_one(spark, make):
    """Only the search for the runs grows, with the logarithm of their length; the propagation is one step for both."""
    inputs = spark.createDataFrame([("T", [1.0] * 5)], "tree string, curve array<double>")
    jobs = {}
    for n in (10, 10_000):
        found, looked = jobs_of(spark, lambda: single_runs(chain_of(make, n)))
        assert found[1] == 1
        wide, all_jobs = jobs_of(spark, lambda: S.delay_propagation(chain_of(make, n), F.lit(0.01), inputs, 0.1))
        assert wide.count() == n
        jobs[n] = looked, all_jobs - looked
    assert abs(jobs[10_000][1] - jobs[10][1]) <= 2
    assert jobs[10_000][0] - jobs[10][0] <= 12 * math.log2(1000)


def test_delays_of_an_empty_forest(spark, make):
    inputs = spark.createDataFrame([("T", [1.0])], "tree string, curve array<double>")
    assert S.delay_propagation(chain_of(make, 3).limit(0), F.lit(1.0), inputs, 0.1).count() == 0


def turned_walk(rows, gamma):
    """Every row from its parent's end, one by one; ``rows`` are (id, parent, p, d, radius), parents first."""
    from arborlake.functions import geometry as g

    kids, placed = {}, {}
    for i, parent, *_ in rows:
        kids.setdefault(parent, []).append(i)
    radius = {r[0]: r[4] for r in rows}

    def bend(parent, own, other, flat):
        den = 2 * parent**2 * own**2
        c = min(max((parent**4 + own**4 - other**4) / den, -1), 1) if den > g.DEGENERATE_SQ else flat
        return min(math.acos(c), g.ANGLE_CAP)

    for i, parent, p, d, _ in rows:
        own = np.subtract(d, p)
        if parent < 0:
            placed[i] = np.array(p), np.array(d)
            continue
        start, axis = placed[parent][1], placed[parent][1] - placed[parent][0]
        sibs = sorted(kids[parent])
        if len(sibs) == 1 or not np.linalg.norm(axis) > 0:
            placed[i] = start, start + own
            continue
        r, slot = [radius[s] for s in sibs], sibs.index(i)
        if len(sibs) == 2:
            large = r[0] >= r[1] if slot == 0 else r[0] < r[1]
            rho = min(r) / max(r)
            if rho < g.RHO_TH:
                angle = min(bend(1, 1, rho, 1.0), g.STRAIGHT_CAP) if large else bend(1, rho, 1, 0.0)
            else:
                whole = (1 + rho**gamma) ** (1 / gamma)
                angle = bend(whole, 1, rho, 1.0) if large else bend(whole, rho, 1, 0.0)
            turn = 0.0 if large else math.pi
        else:
            w = [1 / (x + 1e-20) for x in r]
            angle, turn = g.THREE_WAY_BUDGET * w[slot] / sum(w), slot * 2 * math.pi / 3
        u = axis / np.linalg.norm(axis)
        e = np.zeros(3)
        e[np.abs(u).argmin()] = 1
        q = np.cross(u, e) / np.linalg.norm(np.cross(u, e))
        way = u * math.cos(angle) + (q * math.cos(turn) + np.cross(u, q) * math.sin(turn)) * math.sin(angle)
        placed[i] = start, start + way * np.linalg.norm(own)
    return placed


def test_rows_placed_along_runs_against_a_walk(spark, make):
    r = random.Random(8)
    kids, rows = {}, []
    for i, parent in mixed_tree(150, 9):
        while parent > 0 and kids.get(parent, 0) == 3:
            parent = r.randint(1, i - 1)
        kids[parent] = kids.get(parent, 0) + 1
        rows.append((i, parent, [r.uniform(-5, 5) for _ in range(3)], [r.uniform(-5, 5) for _ in range(3)], r.uniform(0.1, 1)))
    want = turned_walk(rows, 7 / 3)
    segs = make([(i, parent, *p, *d, radius) for i, parent, p, d, radius in rows])
    got = {x["id"]: x for x in growth.junction_geometry(segs, 7 / 3).collect()}
    assert len(got) == len(rows) and {sum(v == k for v in kids.values()) > 0 for k in (1, 2, 3)} == {True}
    for i, (start, end) in want.items():
        assert np.allclose([got[i][c] for c in ("px", "py", "pz")], start, atol=1e-9) and np.allclose([got[i][c] for c in ("dx", "dy", "dz")], end, atol=1e-9)
        assert got[i]["length_mm"] == pytest.approx(np.linalg.norm(end - start))


def test_a_long_chain_is_placed_in_one_step(spark, make):
    out, n = jobs_of(spark, lambda: growth.junction_geometry(chain_of(make, 3_000), 7 / 3))
    short, few = jobs_of(spark, lambda: growth.junction_geometry(chain_of(make, 10), 7 / 3))
    assert n - few <= 12 * math.log2(300)
    assert out.where("abs(dx - id) > 1e-6").count() == 0 and out.count() == 3_000
