import numpy as np
from pyspark.sql import functions as F

from arborlake.catalog import q_series
from arborlake.operators import lines as L

ITEM = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double, l_tax double, l_discount double"


def test_lines_are_numbered_once_for_slices_and_reversals(spark, tmp_path):
    sizes = {1: 5, 2: 1, 3: 3, 4: 2}
    items = [(k, n, 1, 1, 100.0, 10.0 * n + k, 0.0, 0.0) for k, size in sizes.items() for n in range(size, 0, -1)] + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0)]
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = q_series.slice_reverse(spark, str(tmp_path))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for k, size in sizes.items():
        x = [(10.0 * n + k) / 10 for n in range(1, size + 1)]
        want |= {(k, "sliced", i + 1, v) for i, v in enumerate(x[min(3, size) - 1:])}
        want |= {(k, "reversed", i + 1, v) for i, v in enumerate(x[::-1])}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_resampling_meets_no_table_of_sizes(spark):
    rng = np.random.default_rng(4)
    rows = [(k, n + 1, *map(float, rng.uniform(0, 6, 3)), float(rng.uniform(0.2, 2))) for k in range(12) for n in range(k)]
    points = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 0.0, 1.0)], "line bigint, pos int, x double, y double, z double, radius_mm double")
    whole = L.resample(points)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    sliced = L.resample(points, slice_points=4)
    shown = [[tuple(r) for r in t.orderBy("line", "pos").select("line", "pos", *[F.round(c, 6) for c in L.POINT]).collect()] for t in (whole, sliced)]
    assert shown[0] == shown[1] and {r[0] for r in shown[0]} == set(range(1, 12))


def test_lines_are_numbered_once_for_joints_and_summaries(spark, tmp_path):
    rng = np.random.default_rng(5)
    items = [(k, n, 1, 1, *map(float, rng.uniform([1e3, 1, 0, 0], [6e4, 50, 0.08, 0.1]))) for k in range(1, 15) for n in range(1, 2 + k % 4)]
    spark.createDataFrame([*items, (None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0)], ITEM).write.parquet(f"{tmp_path}/lineitem.parquet")
    summary, joints = q_series.tree_summary(spark, str(tmp_path)), q_series.joints(spark, str(tmp_path))
    for table in (summary, joints):
        assert "Window" not in table._jdf.queryExecution().optimizedPlan().toString()
    at = {}
    for k, _, _, _, price, quantity, tax, discount in items:
        at.setdefault(k, []).append(((quantity / 10, price / 10000, tax * 50), 0.2 + discount * 20))
    assert {(r["parent"], r["child"]) for r in joints.collect()} == {(k // 2, k) for k in at if k > 1}
    gaps = {r["child"]: r["gap_mm"] for r in joints.collect()}
    got = {r["tree"]: r for r in summary.collect()}
    for t in range(7):
        mine = [p for k in at if k % 7 == t for p in at[k]]
        assert (got[t]["n_lines"], got[t]["n_points"]) == (sum(k % 7 == t for k in at), len(mine))
        assert abs(got[t]["r_mean"] - np.mean([r for _, r in mine])) < 1e-6
        assert got[t]["max_gap_mm"] == max((g for k, g in gaps.items() if k % 7 == t), default=0)
