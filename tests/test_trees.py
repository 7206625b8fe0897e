import math
import random

import pytest
from pyspark.sql import functions as F

from arborlake.functions import flow
from arborlake.operators import stats, trees
from arborlake.plans import lookup as lookup_plan


def by_id(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def test_chain_orders_and_elements(chain):
    orders = trees.topological_order(chain)
    assert by_id(orders, "strahler_order") == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1}
    ordered = chain.join(orders, ["tree", "id"])
    table = {r["element_id"]: r for r in trees.element_table(ordered).collect()}
    assert set(table) == {1, 3, 4, 5}
    assert table[1]["mean_d_um"] == pytest.approx(150.0)
    assert table[1]["length_um"] == pytest.approx((5 + math.sqrt(34)) * 1000)
    matrix = {(r["child_order"], r["parent_order"]): r["value"] for r in stats.element_connectivity(ordered).collect()}
    assert matrix == {(1, 2): 3.0}


def test_one_tube_and_fork_flow(make):
    tube = make([(1, -1, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 1.0)]).withColumn("resistance", flow.resistance(F.col("length_mm"), F.col("radius_mm")))
    row = trees.flows_and_pressures(tube, F.lit(100.0), F.lit(10.0)).first()
    r = 8 * flow.VISCOSITY * 0.01 / (math.pi * 1e-12)
    assert row["flow_m3_s"] == pytest.approx(90 / r)
    assert row["p_dist_pa"] == pytest.approx(10.0)


def random_forest(n, seed, deep):
    rnd = random.Random(seed)
    kids, rows = {}, []
    for i in range(1, n + 1):
        if i == 1:
            p = -1
        else:
            while True:
                p = i - 1 if rnd.random() < deep else rnd.randint(1, i - 1)
                if kids.get(p, 0) < 3:
                    break
            kids[p] = kids.get(p, 0) + 1
        rows.append((i, p, 0.0, 0.0, 0.0, rnd.random(), rnd.random(), rnd.random(), 0.01 + rnd.random()))
    return rows


@pytest.mark.parametrize("deep", [0.2, 0.97])
def test_roll_ups_match_a_loop(make, deep):
    rows = random_forest(300, 5, deep)
    segs = make(rows).withColumn("resistance", F.col("radius_mm"))
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r[0])
    own = {r[0]: r[-1] for r in rows}
    order, res, size, power = {}, {}, {}, {}
    for i in reversed(range(1, 301)):
        c = kids.get(i, [])
        top = max((order[k] for k in c), default=0)
        order[i] = 1 if not c else top + (sum(order[k] == top for k in c) >= 2)
        res[i] = own[i] + (1 / sum(1 / res[k] for k in c) if c else 0)
        size[i] = 1 + sum(size[k] for k in c)
        power[i] = own[i] ** 2.5 if not c else sum(power[k] for k in c)
    assert by_id(trees.topological_order(segs), "strahler_order") == order
    assert by_id(trees.subtree_resistance(segs), "r_sub") == pytest.approx(res)
    assert by_id(trees.subtree_sums(segs, {"n": F.lit(1.0)}), "n") == pytest.approx(size)
    assert by_id(trees.power_radii(segs, 2.5), "radius_mm") == pytest.approx({i: v ** 0.4 for i, v in power.items()})
    depth = {1: 0}
    for r in rows[1:]:
        depth[r[0]] = depth[r[1]] + 1
    assert by_id(trees.depths(segs), "depth") == depth


def test_sums_below_cycles_orphans_and_a_hot_row(make):
    """Rows on a cycle drop out, what hangs on them does not; half of all rows hang on one row; a chain of 400 rows."""
    nowhere = [0.0] * 6
    rows = [(1, -1, *nowhere, 1.0), (2, 1, *nowhere, 1.0), (3, 77_777, *nowhere, 1.0), (4, 5, *nowhere, 1.0), (5, 6, *nowhere, 1.0), (6, 4, *nowhere, 1.0)]
    rows += [(7, 4, *nowhere, 1.0), (8, 7, *nowhere, 1.0), (9, 3, *nowhere, 1.0)]
    rows += [(i, 2, *nowhere, 1.0) for i in range(100, 900)] + [(1000, 150, *nowhere, 1.0)] + [(i, i - 1, *nowhere, 1.0) for i in range(1001, 1400)]
    got = by_id(trees.subtree_sums(make(rows), {"n": F.lit(1.0), "twice": F.lit(2.0)}), "n")
    want = {1: 1202, 2: 1201, 3: 2, 7: 2, 8: 1, 9: 1, 150: 401} | {i: 1 for i in range(100, 900) if i != 150} | {i: 1400 - i for i in range(1000, 1400)}
    assert got == want
    assert trees.subtree_sums(make(rows).limit(0), {"n": F.lit(1.0)}).count() == 0


def test_orphans_and_cycles_do_not_appear(make):
    segs = make([(1, -1, *[0.0] * 6, 1.0), (2, 1, *[0.0] * 6, 1.0), (3, 9, *[0.0] * 6, 1.0), (4, 5, *[0.0] * 6, 1.0), (5, 4, *[0.0] * 6, 1.0)])
    assert by_id(trees.depths(segs), "depth") == {1: 0, 2: 1}


def test_hot_keys_take_the_broadcast_side(spark, monkeypatch):
    monkeypatch.setattr(lookup_plan, "PLAIN_ROWS", 10)
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    out = lookup_plan.lookup(left, right, ["k"], 5000)
    assert out.count() == 5000
    assert out.where("w <> k * 2").count() == 0


def test_neighbourhood_and_hop_distance(make):
    rows = random_forest(60, 3, 0.5)
    segs = make(rows)
    near = {}
    for r in rows:
        near.setdefault(r[0], set())
        if r[1] > 0:
            near[r[0]].add(r[1])
            near.setdefault(r[1], set()).add(r[0])
    expect = set()
    for s in near:
        seen, front = {s: 0}, [s]
        for h in range(1, 4):
            front = [m for f in front for m in near[f] if m not in seen and not seen.update({m: h})]
        expect |= {(s, k, v) for k, v in seen.items()}
    got = {(r["start"], r["id"], r["hops"]) for r in trees.neighbourhood(segs, 3).collect()}
    assert got == expect
    up = trees.recent_ancestors(segs, 3)
    pairs = up.select(F.col("id").alias("a"), F.col("up").alias("ua"), F.lit(1).alias("x")).join(
        up.select(F.col("id").alias("b"), F.col("up").alias("ub"), F.lit(1).alias("x")), "x")
    hop = pairs.select("a", "b", trees.hop_distance(F.col("ua"), F.col("ub")).alias("h")).where("h <= 3")
    assert {(r["a"], r["b"], r["h"]) for r in hop.collect()} == expect


def test_diameter_order_matches_a_loop(make):
    rows = random_forest(200, 8, 0.3)
    segs = make(rows)
    order = by_id(trees.topological_order(segs), "strahler_order")
    d = {r[0]: r[-1] * 2000 for r in rows}
    for rounds in range(1, 21):
        top = max(order.values())
        bounds, mean, sd = [0.0], [], []
        for o in range(top + 1):
            v = [d[i] for i in d if order[i] == o]
            m = sum(v) / len(v) if v else 0.0
            mean.append(m)
            sd.append(math.sqrt(sum((x - m) ** 2 for x in v) / len(v)) if v else 0.0)
        for k in range(1, top + 1):
            bounds.append(max((mean[k - 1] + sd[k - 1] + mean[k] - sd[k]) / 2, bounds[-1] + 0.001))
        new = {i: max(k for k, b in enumerate(bounds) if d[i] >= b) for i in d}
        moved = sum(new[i] != order[i] for i in d)
        order = new
        if moved / len(d) < 0.01:
            break
    got = trees.diameter_order(segs)
    assert by_id(got, "strahler_order") == order
    assert got.first()["rounds"] == rounds


@pytest.mark.parametrize("deep, slice_rows", [(0.3, None), (0.9, 20)])
def test_breadth_order_ranks_parents_first_in_slot_order(make, monkeypatch, deep, slice_rows):
    rows = random_forest(300, 11, deep)
    if slice_rows:
        monkeypatch.setattr(trees, "SLICE", slice_rows)
    # Slots against the order of ids, so that neither ids nor depths alone give the order.
    kids = {}
    for r in rows[1:]:
        kids.setdefault(r[1], []).insert(0, r[0])
    slot = {k: i + 1 for c in kids.values() for i, k in enumerate(c)}
    order, depth = [1], {1: 0}
    for at in order:
        depth |= {k: depth[at] + 1 for k in kids.get(at, [])}
        order += kids.get(at, [])
    table = F.create_map(*[F.lit(v) for pair in slot.items() for v in pair])
    # Rows that hang on no root have no place.
    segs = make([*rows, (900, 901, *[0.0] * 6, 1.0), (901, 900, *[0.0] * 6, 1.0)])
    got = trees.breadth_order(segs.withColumn("child_slot", F.coalesce(F.try_element_at(table, F.col("id").cast("int")), F.lit(0)))).collect()
    assert {r["id"]: r["rank"] for r in got} == {v: i + 1 for i, v in enumerate(order)}
    assert {r["id"]: r["depth"] for r in got} == depth
    assert all(r["level_rows"] == list(depth.values()).count(r["depth"]) for r in got)
