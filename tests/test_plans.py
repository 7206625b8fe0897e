import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import spatial
from arborlake.operators import lines as L
from arborlake.plans import boxes, running
from arborlake.plans.cut import work_dir


def test_work_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert not named or work_dir(spark).startswith(named.rstrip("/"))


def test_running_sum_in_slices(spark):
    df = spark.range(1, 1001).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("pos"), (F.col("id") % 7).cast("double").alias("v"))
    a = running.running_sum(df, ["k"], "pos", {"s": F.col("v")}).select("pos", "s")
    b = running.running_sum(df, ["k"], "pos", {"s": F.col("v")}, slice_rows=64).select("pos", "s")
    assert a.exceptAll(b).count() == 0 and b.count() == 1000


def test_cumulative_in_slices(spark, all_ranges):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 7919 % 1009).cast("double").alias("v"), "id")
    a = running.cumulative(df, ["k"], "v", ["id"]).select("id", "upto", "total")
    b = running.cumulative(df, ["k"], "v", ["id"], plain_group=10).select("id", "upto", "total")
    assert a.exceptAll(b).count() == 0 and b.count() == 3000
    c = running.cumulative(df, [], "v", ["id"], plain_group=10)
    assert c.agg(F.max("upto"), F.count_distinct("upto")).first()[:] == (3000, 3000)


@pytest.mark.parametrize("ranges", [4096, 3])
def test_first_rows_are_those_of_the_sort_without_a_sort(spark, ranges):
    from arborlake.plans.cut import cut

    df = spark.range(3000).select((F.col("id") * 7919 % 3001 * (F.col("id") % 5 + 1) * 1_000_003 - 2_000_000_000).alias("k")).distinct()
    table = cut(df.unionByName(spark.createDataFrame([(None,)], "k long")), "t")
    keys = sorted(r["k"] for r in df.collect())
    for n in (0, 1, 17, 1500, len(keys) - 1, len(keys), len(keys) + 5):
        got = running.first_rows(table, "k", n, ranges)
        assert sorted(r["k"] for r in got.collect()) == keys[:n]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Sort" not in plan and "TakeOrdered" not in plan
    assert running.first_rows(table.limit(0), "k", 3).count() == 0


@pytest.fixture
def all_ranges(spark):
    """No small ranges are put together at run time."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_scan_splits_a_value_that_half_of_the_rows_share(spark, all_ranges):
    """Ranges are even although half of the rows are the same in all columns, and no edge of a range is in a plan."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id") % 97).cast("double").alias("v"))
    table, plain = running._written(df, ["k"], 10, "t")
    parts = running.ranges(table, ["k"], ["v"])
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert not plain and len(sizes) > 4 and max(sizes) < 10_000 and sum(sizes) == 20_000
    low_high = parts.groupBy("_part").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_part").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(low_high, low_high[1:]))
    run = running.cumulative(df, ["k"], "v", plain_group=10)
    assert run.agg(F.count_distinct("upto"), F.min("upto"), F.max("upto"), F.max("total")).first()[:] == (20_000, 1, 20_000, 20_000)
    assert run.where("v = 7.0").agg(F.max("upto") - F.min("upto") + 1).first()[0] == df.where("v = 7.0").count()
    text = run._jdf.queryExecution().toString()
    assert "percentile" not in text and "array(" not in text
    # A series with 10,000 samples at one time: the last of them is met.
    samples = spark.range(20_000).select(F.lit("a").alias("k"), F.greatest(F.col("id"), F.lit(10_000)).cast("double").alias("t"), F.col("id").alias("x"))
    asked = spark.createDataFrame([("a", 10_000.0), ("a", 9_999.0), ("a", 15_000.5)], "k string, t double")
    got = {r["t"]: (r["prev_t"], r["next_t"]) for r in running.as_of(asked, samples, ["k"], "t", "x", plain_group=10).collect()}
    assert got == {10_000.0: (10_000.0, 10_001.0), 9_999.0: (None, 10_000.0), 15_000.5: (15_000.0, 15_001.0)}


def test_small_groups_of_a_large_table_take_the_plain_window(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    assert running._written(df, ["k"], 10, "t")[1] and not running._written(df, ["k"], 9, "t")[1]
    assert running._written(df, [], 1000, "t")[1] and not running._written(df, [], 999, "t")[1]


def test_empty_tables_in_both_plans(spark):
    df = spark.range(0).select(F.lit("a").alias("k"), F.col("id").alias("v"))
    assert running.cumulative(df, ["k"], "v").count() == 0
    asked = spark.createDataFrame([("a", 1)], "k string, v long")
    got = running.as_of(asked, df.withColumn("x", F.lit(1)), ["k"], "v", "x", plain_group=0).collect()
    assert [(r["prev_t"], r["next_t"]) for r in got] == [(None, None)]


def test_strata_of_a_decimation_with_ties_and_null_keys(spark):
    from arborlake.operators import ranking

    rows = [(None if i % 3 == 0 else "a", i, float(i % 5)) for i in range(900)] + [("few", i, 1.0) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    got = ranking.decimate(df, ["k"], "v", ["id"], 20)
    kept = {k: sorted(r["id"] for r in got.where(F.col("k").eqNullSafe(k)).collect()) for k in (None, "a", "few")}
    for k in kept:
        mine = [r for r in rows if r[0] == k]
        if len(mine) <= 20:
            want = {r[1] for r in mine}
        else:
            top = [r[1] for r in sorted(mine, key=lambda r: (-r[2], r[1]))[:5]]
            low = [r[1] for r in sorted(mine, key=lambda r: (r[2], r[1]))[:9]]
            rest = sorted(r[1] for r in mine if r[1] not in {*top, *low})
            step = (len(rest) - 1) / 5
            want = {*top, *low, *(rest[round(i * step)] for i in range(6))}
        assert kept[k] == sorted(want)


def test_as_of_in_slices(spark, all_ranges):
    rnd = random.Random(1)
    samples = [(rnd.choice("ab"), rnd.randint(0, 4000), float(i)) for i in range(800)]
    samples = list({(k, t): (k, t, v) for k, t, v in samples}.values())
    asked = [(rnd.choice("ab"), rnd.randint(0, 4000), i) for i in range(300)]
    s = spark.createDataFrame(samples, "k string, t long, v double")
    q = spark.createDataFrame(asked, "k string, t long, n int")
    for limit in (10**6, 5):
        got = {r["n"]: (r["prev_t"], r["next_t"]) for r in running.as_of(q, s, ["k"], "t", "v", plain_group=limit).collect()}
        for k, t, n in asked:
            before = max((u for kk, u, _ in samples if kk == k and u <= t), default=None)
            after = min((u for kk, u, _ in samples if kk == k and u > t), default=None)
            assert got[n] == (before, after)


def clustered(n, seed):
    """Two thirds in one tiny cluster, some of them on the same spot."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3:
            c = rnd.choice([0.0, 1e-7, 2e-7])
            out.append((i, 90 + c, 90 + c, 90.0))
        else:
            out.append((i, rnd.random() * 100, rnd.random() * 100, rnd.random() * 100))
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_k_nearest_on_a_dense_cluster(spark, k):
    pts, qs = clustered(900, 2), clustered(60, 9)
    items = spark.createDataFrame(pts, "id long, sx double, sy double, sz double")
    queries = spark.createDataFrame(qs, "qid long, x double, y double, z double")
    s, q = tuple(F.col(f"s{a}") for a in "xyz"), tuple(F.col(a) for a in "xyz")
    index = boxes.build(items, s, s)
    assert index.crowded
    d = sum(((a - b) * (a - b) for a, b in list(zip(q, s))[1:]), (q[0] - s[0]) * (q[0] - s[0]))
    got = {}
    for r in boxes.k_nearest(queries, ["qid"], q, q, index, k, d, ["id"]).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for qid, *at in qs:
        best = sorted(((sum((a - b) ** 2 for a, b in zip(at, p)), i) for i, *p in pts))[:k]
        assert [i for _, i in sorted(got[qid])] == [i for _, i in best]


def test_segment_pairs_against_brute_force(spark):
    from arborlake.functions import geometry as g
    from arborlake.functions.vectors import lit3
    import numpy as np

    rnd = np.random.default_rng(4)
    for _ in range(20):
        a, b, c, d = rnd.random((4, 3))
        u = np.linspace(0, 1, 201)
        pa = a + u[:, None] * (b - a)
        pc = c + u[:, None] * (d - c)
        brute = np.min(np.linalg.norm(pa[:, None] - pc[None], axis=2))
        got = spark.range(1).select(F.sqrt(g.segment_segment_sq(lit3(a), lit3(b), lit3(c), lit3(d)))).first()[0]
        assert got <= brute + 1e-9 and got >= brute - 0.01


def test_resample_is_the_same_in_slices(spark):
    rows = [(1, i + 1, i * 0.3, (i % 5) * 0.1, 0.0, 0.5 + (i % 40) * 0.05) for i in range(200)] + [(2, 1, 0.0, 0.0, 0.0, 1.0), (2, 2, 0.1, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "line long, pos int, x double, y double, z double, radius_mm double")
    whole = L.resample(df).select("line", "pos", *[F.round(c, 9) for c in L.POINT])
    parts = L.resample(df, slice_points=17).select("line", "pos", *[F.round(c, 9) for c in L.POINT])
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
    straight = spark.createDataFrame([(1, i + 1, float(i), 0.0, 0.0, 1.0) for i in range(11)], "line long, pos int, x double, y double, z double, radius_mm double")
    out = L.resample(straight, 2.0, 2.0).orderBy("pos").collect()
    assert [r["x"] for r in out] == pytest.approx([0, 2, 4, 6, 10])


def test_octahedron_surface(spark):
    pts = [(a * s if i == 0 else 0.0, a * s if i == 1 else 0.0, a * s if i == 2 else 0.0) for i in range(3) for a in (1.0,) for s in (1.0, -1.0)]
    surf = spark.createDataFrame([("o", n, *p, *p) for n, p in enumerate(pts)], "surface string, id long, x double, y double, z double, nx double, ny double, nz double")
    q = spark.createDataFrame([(1, "o", 0.0, 0.0, 0.0), (2, "o", 1.5, 0.0, 0.0)], "qid int, surface string, x double, y double, z double")
    off = {r["qid"]: r["offset"] for r in spatial.nearest_surface_point(q, surf).collect()}
    assert off[1] <= 0 < off[2]
    back = {r["qid"]: r["x"] for r in spatial.project_to_surface(q, surf).collect()}
    assert back[2] == pytest.approx(1.0, abs=1e-4)


def _both(plain, sliced):
    rows = [sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in (plain, sliced)]
    assert plain.columns == sliced.columns and rows[0] == rows[1] and rows[0]


def test_sliced_and_plain_windows_agree_with_null_keys_and_a_hot_key(spark, all_ranges):
    from pyspark.sql import functions as F

    from arborlake.plans import running

    rows = [("hot", i + 1, float(i * 37 % 101)) for i in range(400)] + [("b", i + 1, float(i)) for i in range(30)]
    rows += [(None, i + 1, float(-i)) for i in range(60)] + [("c", 1, None), ("c", 2, 4.0), (None, 61, None)]
    df = spark.createDataFrame(rows, "k string, pos long, v double")
    _both(running.running_sum(df, ["k"], "pos", {"s": F.col("v")}), running.running_sum(df, ["k"], "pos", {"s": F.col("v")}, slice_rows=16))
    plain = running.cumulative(df, ["k"], "v", ["pos"])
    _both(plain, running.cumulative(df, ["k"], "v", ["pos"], plain_group=1))
    _both(running.cumulative(df, [], "v", ["k", "pos"]), running.cumulative(df, [], "v", ["k", "pos"], plain_group=1))
    asked = spark.createDataFrame([("hot", 0.5), ("hot", 200.0), (None, -3.5), ("b", 7.0), ("none", 1.0)], "k string, t double")
    samples = df.select("k", F.col("v").alias("t"), F.col("pos").cast("double").alias("x")).where("v IS NOT NULL").dropDuplicates(["k", "t"])
    _both(running.as_of(asked, samples, ["k"], "t", "x"), running.as_of(asked, samples, ["k"], "t", "x", plain_group=1))


def test_neighbour_meets_null_keys_beyond_the_slice_size(spark, monkeypatch):
    from arborlake.plans import running

    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 5.0)], "k string, pos long, v double")
    plain = running.neighbour(df, ["k"], "pos", 1, ["v"], "n_")
    monkeypatch.setattr(running, "SLICE", 1)
    _both(plain, running.neighbour(df, ["k"], "pos", 1, ["v"], "n_"))


def test_coincident_ends_of_two_trees_do_not_make_all_pairs(spark):
    """100,000 segments on one spot, a few beside them: every end still finds the other tree, and its first segment."""
    n = 100_000
    spot = spark.range(n).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("tree"), F.col("id"), F.lit(1.0).alias("px"), (F.rand(3) * 0 + 0.1 + F.col("id") % 3).alias("radius_mm"))
    far = spark.range(n, n + 40).select(F.lit("A").alias("tree"), F.col("id"), (5.0 + F.col("id") % 7).alias("px"), F.lit(0.1).alias("radius_mm"))
    segs = spot.unionByName(far).withColumns({"py": F.lit(0.0), "pz": F.lit(0.0), "dx": F.col("px") + 1, "dy": F.lit(0.0), "dz": F.lit(0.0)})
    met = spatial.collisions(segs, 0.5)
    assert met.agg(F.count("*"), F.max("distance"), F.count_distinct("tree", "id")).first()[:] == (n, 0.0, n)
    ends = segs.where("id < 20000 OR id >= 100000")
    near = spatial.nearest_other_terminal(ends)
    assert near.where("id < 20000").agg(F.count("*"), F.max("nearest")).first()[:] == (20_000, 0.0)
    assert near.where("id >= 100000").count() == 40


def test_poisson_draws_of_any_rate(spark):
    from pyspark.sql import functions as F

    from arborlake.functions import draws

    rows = spark.range(20_000).select(F.explode(F.array(*[F.lit(r) for r in (0.0, 2.75, 80.0, 601.0, 900.0, 3000.0)])).alias("rate"), draws.uniform([F.col("id")], 3).alias("u"))
    for r in rows.groupBy("rate").agg(F.avg(draws.poisson(F.col("rate"), F.col("u"))).alias("m"), F.variance(draws.poisson(F.col("rate"), F.col("u"))).alias("v")).collect():
        assert abs(r.m - r.rate) <= 0.05 * r.rate ** 0.5 + 1e-9 and abs(r.v - r.rate) <= 0.06 * r.rate + 1e-9


def test_collision_limit_is_in_the_search(spark):
    from arborlake.operators import spatial

    rows = [(t, i, -1, i * 10.0, y, 0.0, i * 10.0 + 1, y, 0.0, 0.1, 1.0) for i in range(50) for t, y in (("A", 0.0), ("B", 0.5 if i % 7 == 0 else 4.0))]
    segs = spark.createDataFrame(rows, "tree string, id long, parent_id long, px double, py double, pz double, dx double, dy double, dz double, radius_mm double, length_mm double")
    got = {(r.tree, r.id) for r in spatial.collisions(segs, 1.0).collect()}
    assert got == {(t, i) for i in range(0, 50, 7) for t in "AB"}


def test_files_of_one_name_in_several_folders(spark, tmp_path):
    from pyspark.sql import functions as F

    from arborlake.sources import tables as S

    pts = spark.createDataFrame([(n, p, float(p), 0.0, float(n), 1.0) for n in (3, 7) for p in range(1, 200)], "line long, pos int, x double, y double, z double, radius_mm double")
    S.write_centerlines(pts, f"{tmp_path}/lines")
    back = S.read_centerlines(spark, f"{tmp_path}/lines").select(F.col("line").cast("long"), "pos", "x", "y", "z", "radius_mm")
    assert sorted(back.collect()) == sorted(pts.collect())
