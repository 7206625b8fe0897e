import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import distributions as dist, domains, draws, flow, morphometry
from arborlake.operators import growth, series as S, stats, surfaces as N, synth, territory, trees, voxels as V
from arborlake.sources.raw_labels import read_raw_labels


def test_cdfs_against_the_standard_library(spark):
    z = [-8.0, -3.0, -0.5, 0.0, 0.7, 2.5, 7.5]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", dist.normal_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=1e-9, abs=1e-15)
    for x, dof, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (24.99579013972863, 15, 0.05)):
        got = spark.range(1).select(dist.chi_square_tail(F.lit(x), F.lit(dof))).first()[0]
        assert got == pytest.approx(p, rel=1e-7)


def test_ks_accepts_and_rejects(spark):
    v = spark.range(200).select(F.lit("g").alias("g"), (100 + 10 * draws.normal([F.col("id")], 3)).alias("v"))
    ok = stats.ks_one_sample(v, ["g"], "v", lambda x: dist.normal_cdf((x - 100) / 10)).first()
    bad = stats.ks_one_sample(v, ["g"], "v", lambda x: dist.normal_cdf((x - 200) / 10)).first()
    assert ok["d"] < 0.15 and ok["p"] > 0.05 and bad["d"] > 0.5 and bad["p"] < 0.01


def test_draws_follow_their_laws(spark):
    n = 20000
    key = [F.col("id")]
    d = spark.range(n).select(
        draws.beta(draws.uniform(key, 1)).alias("b"), draws.poisson(F.lit(2.75), draws.uniform(key, 2)).alias("p"),
        draws.truncated_lognormal(F.lit(100.0), F.lit(20.0), key, 3).alias("l"),
        draws.weighted_pick(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(0), F.lit(1)), draws.uniform(key, 4)).alias("w"))
    r = d.agg(F.avg("b").alias("b"), F.variance("b").alias("vb"), F.avg("p").alias("p"), F.variance("p").alias("vp"), F.avg("l").alias("l"), F.avg("w").alias("w")).first()
    assert r["b"] == pytest.approx(2.5 / 3.3, abs=0.01) and r["vb"] == pytest.approx(2.5 * 0.8 / (3.3**2 * 4.3), rel=0.05)
    assert r["p"] == pytest.approx(2.75, abs=0.05) and r["vp"] == pytest.approx(2.75, rel=0.05)
    assert r["l"] == pytest.approx(100, rel=0.02) and r["w"] == pytest.approx(0.75, abs=0.02)
    assert draws.uniform(key, 1) is not None
    a = spark.range(100).repartition(7).select(draws.uniform(key, 1).alias("u"))
    assert a.exceptAll(spark.range(100).select(draws.uniform(key, 1).alias("u"))).count() == 0


def test_step_response(make):
    q = 1e-6
    seg = make([(1, -1, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 1.0)])
    inputs = seg.select("tree").withColumn("curve", F.array_repeat(F.lit(10.0), 31))
    wide = S.delay_propagation(seg, F.lit(1.0), inputs, 0.1)
    rows = {r["t_idx"]: r for r in S.long_form(wide, ["tree", "id"], ["outlet", "content"], 0.0, 0.1).collect()}
    assert rows[5]["content"] == pytest.approx(5.0) and rows[15]["content"] == pytest.approx(10.0)
    assert rows[9]["outlet"] == 0.0 and rows[10]["outlet"] == pytest.approx(10.0)


def test_components_and_islands(spark):
    rng = np.random.default_rng(3)
    own = rng.integers(0, 2, size=(7, 6, 5))
    cells = spark.createDataFrame([(i + 1, j + 1, k + 1, int(own[i, j, k])) for i in range(7) for j in range(6) for k in range(5)], "i int, j int, k int, owner int")
    label, seen = {}, {}
    for start in np.ndindex(own.shape):
        if start in label:
            continue
        stack, label[start] = [start], start
        while stack:
            c = stack.pop()
            for f in V._FACES:
                m = tuple(a + b for a, b in zip(c, f))
                if all(0 <= a < s for a, s in zip(m, own.shape)) and m not in label and own[m] == own[c]:
                    label[m] = start
                    stack.append(m)
    got = {(r["i"] - 1, r["j"] - 1, r["k"] - 1): r["component"] for r in V.components(cells).collect()}
    assert len(got) == own.size
    assert len(set(zip((label[c] for c in label), (got[c] for c in label)))) == len(set(label.values())) == len(set(got.values()))
    size = {}
    for c in label:
        size[label[c]] = size.get(label[c], 0) + 1
    cleaned = {(r["i"] - 1, r["j"] - 1, r["k"] - 1): r["owner"] for r in V.clean_islands(cells, min_voxels=4).collect()}
    for c in label:
        around = [m for d in label if label[d] == label[c] for f in V._FACES for m in [tuple(a + b for a, b in zip(d, f))] if m in label and own[m] != own[c]]
        flip = size[label[c]] < 4 and around
        assert cleaned[c] == (1 - own[c] if flip else own[c])


def test_components_meet_only_at_faces_of_blocks(spark, monkeypatch):
    written = {}

    def seen(df, label="cut", keep=V.cut):
        written[label] = (table := keep(df, label)).count()
        return table

    monkeypatch.setattr(V, "cut", seen)
    full = [(i, j, k, 1) for i in range(1, 13) for j in range(1, 13) for k in range(1, 13)]
    one = V.components(spark.createDataFrame(full, "i int, j int, k int, owner int"))
    assert {r["component"] for r in one.collect()} == {(1 << 42) + (1 << 21) + 1} and written["edges"] == 0
    monkeypatch.setattr(V, "BLOCK", 3, raising=False)
    # A line that winds through blocks, a twin beside it, one row twice, rows without an owner or a place.
    way = [(i, j, 2) for j in range(1, 12, 2) for i in range(1, 12)] + [(11 if n % 2 else 1, 2 * n, 2) for n in range(1, 6)]
    rows = [(*c, "a") for c in way] + [(i, j, 5, "b") for i, j, _ in way] + [(4, 1, 2, "a"), (4, 4, 4, None), (4, 4, 5, None), (None, 1, 1, "a")]
    got = V.components(spark.createDataFrame(rows, "i int, j int, k int, owner string")).collect()
    code = lambda i, j, k: (k << 42) + (j << 21) + i
    assert {r["component"] for r in got if r["owner"] == "a"} == {code(1, 1, 2)} and {r["component"] for r in got if r["owner"] == "b"} == {code(1, 1, 5)}
    assert sum(r["owner"] == "a" for r in got) == len(way) + 3 and sum(r["owner"] is None for r in got) == 2
    assert len({r["component"] for r in got if r["owner"] is None}) == 2


def test_segment_voxels_against_numpy(make):
    seg = make([(1, -1, 1.0, 1.2, 0.7, 4.1, 3.3, 2.9, 0.8)])
    grid = V.Grid((0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (12, 12, 12))
    got = {(r["i"], r["j"], r["k"]): r["share"] for r in V.segment_hits(seg, grid, 2).collect()}
    p, d = np.array([1.0, 1.2, 0.7]), np.array([4.1, 3.3, 2.9])
    expect = {}
    for i, j, k in np.ndindex(12, 12, 12):
        n = 0
        for s in np.ndindex(2, 2, 2):
            c = (np.array([i, j, k]) + (np.array(s) + 0.5) / 2) * 0.5
            t = np.clip(np.dot(c - p, d - p) / np.dot(d - p, d - p), 0, 1)
            n += np.linalg.norm(c - p - t * (d - p)) <= 0.8
        if n:
            expect[(i + 1, j + 1, k + 1)] = n / 8
    assert got == expect


def test_territory_shares(spark):
    config = spark.createDataFrame([("A", -5.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 10, 0.2), ("B", 5.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 10, 0.8)],
                                   "tree string, x double, y double, z double, radius double, dir_x double, dir_y double, dir_z double, target int, fraction double")
    owned, _ = territory.territories(config, None, domains.Sphere((0.0, 0.0, 0.0), 10.0))
    r = owned.where("inside").agg(F.avg((F.col("owner") == "A").cast("double"))).first()[0]
    assert r == pytest.approx(0.2, abs=0.06)


def test_expansion_is_a_forest(spark, make):
    rows = [(i, -1 if i == 1 else 1, 0.0, 0.0, 0.0, float(i), 1.0, 0.5, 0.010) for i in range(1, 4)]
    segs = stats.class_order(make(rows, "RCA"), morphometry.order_params(spark))
    assert {r["strahler_order"] for r in segs.collect()} == {3}
    new = synth.expand_terminals(segs, morphometry.order_params(spark), morphometry.connectivity(spark), 7 / 3, 5, 3)
    both = segs.select("tree", "id", "parent_id", "radius_mm", "px", "py", "pz", "dx", "dy", "dz", "strahler_order", "length_mm").unionByName(new.select("tree", "id", "parent_id", "radius_mm", "px", "py", "pz", "dx", "dy", "dz", "strahler_order", "length_mm"))
    assert both.select("id").distinct().count() == both.count()
    assert trees.depths(both).count() == both.count()
    kids = trees.child_counts(new.unionByName(segs.where("id > 1").select(*[c if c in segs.columns else F.lit(0).alias(c) for c in new.columns])))
    assert kids.where("id <> 1 AND n_children <> 2").count() == 0
    edges = trees.parent_child(both, ["dx", "dy", "dz", "radius_mm", "strahler_order"], ["px", "py", "pz", "radius_mm", "strahler_order"]).where("parent_id <> 1")
    assert edges.where("abs(p_dx - c_px) + abs(p_dy - c_py) + abs(p_dz - c_pz) > 1e-9").count() == 0
    assert edges.where("c_strahler_order > p_strahler_order").count() == 0
    dev = stats.power_law_deviation(both.where("id > 1"), 7 / 3).agg(F.max("deviation")).first()[0]
    assert dev < 1e-9


def test_expansion_takes_all_orders_and_full_depth_stays_inside(spark, make):
    params = morphometry.order_params(spark)
    segs = stats.class_order(make([(1, -1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.020), (2, 1, 1.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0055), (3, 1, 1.0, 0.0, 0.0, 2.0, -1.0, 0.0, 0.0143)], "RCA"), params)
    assert {r["id"]: r["strahler_order"] for r in segs.collect()}[3] == 4
    ball = domains.Sphere((1.0, 0.0, 0.0), 1.6)
    new = synth.expand_terminals(segs, params, morphometry.connectivity(spark), 7 / 3, 5, domain=ball, full_depth=True)
    assert new.where("parent_id = 3").count() == 2
    assert new.where(~domains.Sphere((1.0, 0.0, 0.0), 1.6 + 1e-9).inside((F.col("dx"), F.col("dy"), F.col("dz")))).count() == 0
    both = segs.select("tree", "id", "parent_id", "strahler_order").unionByName(new.select("tree", "id", "parent_id", "strahler_order"))
    assert both.select("id").distinct().count() == both.count()
    # No row is shorter than its order and radius allow, and a row goes on as long as there is room.
    least = F.greatest(F.col("l_mean") / 4000, 2 * F.col("radius_mm"), F.lit(0.008))
    sized = new.join(params.select("artery", F.col("ord").alias("strahler_order"), "l_mean"), ["artery", "strahler_order"])
    assert sized.count() == new.count() and sized.where(F.col("length_mm") < least - 1e-12).count() == 0
    free = synth.expand_terminals(segs, params, morphometry.connectivity(spark), 7 / 3, 5, full_depth=True)
    both = segs.select("tree", "id", "parent_id", "strahler_order").unionByName(free.select("tree", "id", "parent_id", "strahler_order"))
    ends = {r[0]: r[1] for r in trees.with_children(both).where("is_terminal").groupBy("strahler_order").count().collect()}
    assert ends[0] > 0.97 * sum(ends.values())
    forks = {r[0]: r[1] for r in trees.child_counts(both).groupBy("n_children").count().collect()}
    assert set(forks) <= {1, 2} and forks[2] > 0.97 * sum(forks.values())


def test_expansion_does_not_depend_on_partitions_or_batches(spark, make, monkeypatch):
    from arborlake.operators import branching

    params, rates = morphometry.order_params(spark), morphometry.connectivity(spark)
    rows = [(i, -1 if i == 1 else 1, 0.0, 0.0, 0.0, float(i), 1.0, 0.5, 0.004 + 0.0015 * i) for i in range(1, 9)]
    segs = stats.class_order(make(rows, "LAD"), params)
    ball = domains.EllipsoidShell((3.0, 1.0, 0.5), (6.0, 5.0, 4.0), 0.6)
    for domain in (None, ball):
        made = lambda df: sorted(r[:] for r in synth.expand_terminals(df, params, rates, 7 / 3, 9, domain=domain).collect())
        whole = made(segs)
        law = branching.Law([r.asDict() for r in params.collect()], [r.asDict() for r in rates.collect()], 7 / 3)
        monkeypatch.setattr(branching, "FRONT", 7)
        assert made(segs.repartition(5, "id")) == whole and len(whole) > 500
        monkeypatch.setattr(synth, "SLICE", 2)
        assert made(segs) == whole
        monkeypatch.undo()
        ids = sorted(r[2] for r in whole)
        assert ids == list(range(9, 9 + len(ids)))
    grower = branching.Grower(law, None, False)
    ends = {"artery": np.zeros(3, int), "order": np.array([4, 2, 5]), "radius": np.array([0.02, 0.006, 0.03]), "key": np.arange(3).astype(np.uint64), "at": np.zeros((3, 3)), "dir": np.tile([1.0, 0, 0], (3, 1))}
    at_once = sum(np.bincount(m["end"], minlength=3) for m in grower.grow(ends))
    one_by_one = [sum(len(m["end"]) for m in grower.grow({k: v[i : i + 1] for k, v in ends.items()})) for i in range(3)]
    assert at_once.tolist() == one_by_one


def test_laws_of_the_draws_of_an_expansion(spark):
    from arborlake.operators import branching

    params, rates = morphometry.order_params(spark), morphometry.connectivity(spark)
    law = branching.Law([r.asDict() for r in params.collect()], [r.asDict() for r in rates.collect()], 7 / 3)
    a, p, n = law.arteries.index("RCA"), 7, 40_000
    keys, artery = branching.mixed(np.arange(n).astype(np.uint64)), np.full(n, a)
    count, kids = law.daughters(artery, np.full(n, p), keys, False)
    kinds, rate = law.columns[a, p]
    for o, r in zip(kinds, rate):
        assert (kids == o).sum() / n == pytest.approx(r, abs=5 * (r / n) ** 0.5)
    assert count.var() == pytest.approx(sum(rate), rel=0.05) and count.sum() == len(kids)
    starts = np.cumsum(count) - count
    assert all(np.all(np.diff(kids[s : s + c]) >= 0) for s, c in zip(starts[:300], count[:300]))
    full, _ = law.daughters(artery, np.full(n, 1), keys, True)
    assert full.min() == 2
    size = law.length(artery, np.full(n, p), keys) * 1000
    mean, sd = law.l_mean[a, p], law.l_sd[a, p]
    spread = np.sqrt(np.log1p((sd / mean) ** 2))
    free = np.random.default_rng(1).lognormal(np.log(mean) - spread**2 / 2, spread, 200_000)
    kept = free[(free >= 0.1 * mean) & (free <= mean + 3 * sd)]
    assert size.min() >= 0.1 * mean and size.max() <= mean + 3 * sd and size.mean() == pytest.approx(kept.mean(), rel=0.03)
    ratio = law.ratio(artery, np.full(n, 5), np.full(n, 7), keys)
    assert 0.02 < ratio.min() and ratio.max() < 0.99
    large, small = law.split(np.full(n, 0.3), ratio)
    assert np.allclose(large ** (7 / 3) + small ** (7 / 3), 0.3 ** (7 / 3))
    for rate in (0.07, 3.2, 700.0):
        cdf = branching.poisson_cdf(rate)
        draw = np.searchsorted(cdf, branching.uniform(keys, 77))
        assert abs(cdf[-1] - 1) < 1e-9 and draw.mean() == pytest.approx(rate, abs=5 * (rate / n) ** 0.5) and draw.var() == pytest.approx(rate, rel=0.06)


def test_places_in_a_domain_agree_with_the_column_form(spark):
    from arborlake.operators import branching

    shell, r = domains.EllipsoidShell((1.0, 2.0, 3.0), (4.0, 3.0, 2.0), 0.3), np.random.default_rng(2)
    for domain in (shell, domains.Sphere((1.0, 2.0, 3.0), 2.5), domains.Box((0.0, 1.0, 2.0), (3.0, 3.0, 4.0)), domains.Ellipsoid((1.0, 2.0, 3.0), (4.0, 3.0, 2.0))):
        q = r.normal([1.0, 2.0, 3.0] * 2, 2.5, (200, 6))
        df = spark.createDataFrame(q.tolist(), "a double, b double, c double, x double, y double, z double")
        start, to = tuple(F.col(c) for c in "abc"), tuple(F.col(c) for c in "xyz")
        want = df.select(domain.inside(to).alias("i"), *[c.alias(f"k{n}") for n, c in enumerate(domain.clip(start, to))]).toPandas()
        mine = branching.Within(domain)
        assert (mine.inside(q[:, 3:]) == want["i"].to_numpy()).all()
        assert np.allclose(mine.clipped(q[:, :3], q[:, 3:]), want[["k0", "k1", "k2"]].to_numpy(), atol=1e-6)


def test_geometry_keeps_lengths_and_joins(chain):
    out = growth.junction_geometry(chain, 7 / 3)
    old = {r["id"]: r["length_mm"] for r in chain.collect()}
    new = {r["id"]: r["length_mm"] for r in out.collect()}
    assert new == pytest.approx(old)
    edges = trees.parent_child(out, ["dx", "dy", "dz"], ["px", "py", "pz"])
    assert edges.where("abs(p_dx - c_px) + abs(p_dy - c_py) + abs(p_dz - c_pz) > 1e-9").count() == 0


def test_redraw_keeps_the_power_law(chain):
    out = chain.drop("radius_mm").join(growth.redrawn_radii(chain.withColumn("radius_mm", F.col("radius_mm") * 10), 7 / 3, 3), ["tree", "id"])
    assert stats.power_law_deviation(out, 7 / 3).agg(F.max("deviation")).first()[0] < 1e-9


def test_pulled_into_shell(chain):
    shell = domains.EllipsoidShell((0.0, 0.0, 0.0), (12.0, 12.0, 12.0), 0.5)
    out = growth.pulled_inside(chain, shell)
    grown = domains.EllipsoidShell((0.0, 0.0, 0.0), (12.000001, 12.000001, 12.000001), 0.500001)
    assert out.where(~grown.inside((F.col("dx"), F.col("dy"), F.col("dz")))).count() == 0


def test_basis_of_any_degree(spark):
    knots = [0.0, 0.0, 0.0, 0.3, 0.7, 1.0, 1.0, 1.0]

    def cox(i, p, u):
        if p == 0:
            return 1.0 if knots[i] <= u < knots[i + 1] or (u == 1.0 and i == 4) else 0.0
        a, b = knots[i + p] - knots[i], knots[i + p + 1] - knots[i + 1]
        return ((u - knots[i]) / a * cox(i, p - 1, u) if a > 0 else 0) + ((knots[i + p + 1] - u) / b * cox(i + 1, p - 1, u) if b > 0 else 0)

    us = [0.0, 0.1, 0.3, 0.5, 0.71, 1.0]
    df = spark.createDataFrame([(u, knots) for u in us], "u double, k array<double>")
    for r in df.select("u", N.basis(F.col("u"), F.col("k"), F.lit(5)).alias("b")).collect():
        assert r["b"] == pytest.approx([cox(i, 2, r["u"]) for i in range(5)])


def test_raw_labels(spark, tmp_path):
    path = tmp_path / "v.raw"
    path.write_bytes(bytes(range(1, 9)))
    df = read_raw_labels(spark, str(path), (2, 2, 2), reverse=(2,))
    got = {(r["i"], r["j"], r["k"]): r["label"] for r in df.collect()}
    assert got == {(i, 3 - j, k): i + 2 * (j - 1) + 4 * (k - 1) for i in (1, 2) for j in (1, 2) for k in (1, 2)}
    with pytest.raises(Exception, match="bytes"):
        read_raw_labels(spark, str(path), (3, 2, 2)).collect()


def test_no_flow_is_an_error_that_names_the_segment(chain):
    with pytest.raises(Exception, match="no flow in segment"):
        chain.select(flow.transit_time_s(F.lit(1.0), F.lit(0.0), F.col("id"))).collect()


def test_frames_are_stored_as_a_base_and_changes(spark):
    cells = [(i, j, k, (i + j * k) % 4) for i in range(1, 6) for j in range(1, 5) for k in range(1, 9)]
    base = spark.createDataFrame(cells, "i int, j int, k int, label int")
    changed = [(t, i, j, k, 90 + t) for t in (0, 2, 7) for i, j, k, _ in cells if (i * j * k + t) % 11 == 0]
    store = V.store_frames(base, spark.createDataFrame(changed, "t_idx int, i int, j int, k int, label int"))
    assert store.base.count() + store.changes.count() == len(cells) + len(changed)
    new = {c[:4]: c[4] for c in changed}
    for t in (0, 2, 5):
        got = {(r.i, r.j, r.k): r.label for r in V.read_frame(store, t).collect()}
        assert got == {c[:3]: new.get((t, *c[:3]), c[3]) for c in cells}
    part = V.read_frame(store, 7, (2, 1, 3), (4, 4, 5))
    assert {(r.i, r.j, r.k): r.label for r in part.collect()} == {c[:3]: new.get((7, *c[:3]), c[3]) for c in cells if 2 <= c[0] <= 4 and 3 <= c[2] <= 5}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t_idx" in plan and "IsNotNull(k)" in plan
    frames = spark.createDataFrame([(0,), (2,), (5,)], "t_idx int")
    assert {(r.t_idx, r.i, r.j, r.k): r.label for r in V.read_frames(store, frames).collect()} == {(t, *c[:3]): new.get((t, *c[:3]), c[3]) for t in (0, 2, 5) for c in cells}
    bare = V.store_frames(base, spark.createDataFrame([], "t_idx int, i int, j int, k int, label int"))
    assert V.read_frame(bare, 1).exceptAll(base).count() == 0 and V.read_frame(bare, 1).count() == len(cells)


def test_a_repeated_snapshot_replaces_its_run(spark, make, tmp_path):
    from arborlake.sources import runs

    at = lambda day: F.lit(f"2024-01-0{day} 03:04:05").cast("timestamp")
    segs = make([(1, -1, *[0.0] * 6, 1.0), (2, 1, *[0.0] * 6, 1.0)]).unionByName(make([(1, -1, *[0.0] * 6, 1.0)], "U"))
    voxels = spark.createDataFrame([(1, 2, 3)], "i int, j int, k int")
    for day, rows in ((1, segs), (2, segs), (1, segs.where("tree = 'T'"))):
        runs.write_snapshot(str(tmp_path), at(day), rows, voxels=voxels)
    found = spark.read.parquet(f"{tmp_path}/segments").groupBy("run_ts").count().orderBy("run_ts").collect()
    assert [r["count"] for r in found] == [2, 3]
    assert spark.read.text(f"{tmp_path}/manifest").count() == 2 and spark.read.parquet(f"{tmp_path}/voxels").count() == 2


def test_voxel_shares_of_many_and_of_odd_segments(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [("T", i, *map(float, rng.uniform(-2, 9, 6)), float(rng.uniform(0.1, 3))) for i in range(40)]
    rows += [("T", 1, *rows[1][2:]), (None, None, *rows[2][2:]), ("N", 90, None, *rows[3][3:]), ("N", 91, *rows[3][2:8], None), ("N", 92, float("nan"), *rows[3][3:]), ("N", 93, *rows[3][2:8], float("inf")), ("L", 94, 0.0, 0.0, 0.0, 0.0, 140.0, 140.0, 0.4)]
    segs = spark.createDataFrame(rows, "tree string, id bigint, px double, py double, pz double, dx double, dy double, dz double, radius_mm double")
    grid, want = V.Grid((-1.0, 0.0, -0.5), (1.0, 1.5, 2.0), (8, 80, 70)), {}
    subs = [np.array(o) + 0.5 for o in np.ndindex(2, 2, 2)]
    for tree, seg, *at in rows:
        if any(v is None or not np.isfinite(v) for v in at) and tree == "N" and seg != 93:
            continue
        p, q, r = np.array(at[:3]), np.array(at[3:6]), at[6]
        lo = [int(min(max(np.floor((min(u, v) - r - o) / s) + 1, 1), n)) for u, v, o, s, n in zip(p, q, grid.origin, grid.spacing, grid.dims)]
        hi = [int(max(l, min(max(np.ceil((max(u, v) + r - o) / s), 1), n))) for l, u, v, o, s, n in zip(lo, p, q, grid.origin, grid.spacing, grid.dims)]
        a = q - p
        for ijk in np.ndindex(*[h - l + 1 for l, h in zip(lo, hi)]):
            ijk = np.add(ijk, lo)
            spots = [np.array(grid.origin) + (ijk - 1 + o / 2) * grid.spacing for o in subs]
            near = [x - (p + a * min(max((x - p) @ a / (a @ a), 0), 1)) for x in spots]
            n = sum(float(d @ d) <= r * r for d in near)
            if n:
                key = (tree, seg, *map(int, ijk), n / 8)
                want[key] = want.get(key, 0) + 1
    for cells in (V.CELLS, 1_000):
        monkeypatch.setattr(V, "CELLS", cells)
        got = V.segment_hits(segs, grid)
        assert "MapInArrow" in got._jdf.queryExecution().toString()  # not in a stage that is too long to be compiled
        found = {}
        for r in got.collect():
            found[tuple(r)] = found.get(tuple(r), 0) + 1
        assert {k: v for k, v in found.items() if k[1] != 92} == want
