"""Series that travel packed: against plain joins, with repeated and null keys, and without a broadcast series."""

import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import report, series as S
from arborlake.plans import packed as P


@pytest.fixture(params=["packed", "joined"])
def both_ways(request, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr(P, "LONGEST", 1)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = [(t, i, k, k * 0.1, rng.random(), "x") for t in ("a", "b", None) for i in (1, 2, None) for k in range(9) if (i, k) != (2, 4)]
    rows += [("a", 1, 3, 0.3, 0.5, "y"), ("a", 1, None, None, 1.0, None), ("c", 5, 0, 0.0, None, "z")]
    return spark.createDataFrame(rows, "tree string, id bigint, t_idx int, t double, value double, extra string").repartition(3)


def by_joins(series, keys, asked):
    out = series
    for name, (at, value) in asked.items():
        out = out.withColumn("_at", at.cast("bigint"))
        other = series.select(*keys, F.col("t_idx").cast("bigint").alias("_at"), F.col(value).alias(name))
        out = out.join(other, [*keys, "_at"], "left").drop("_at")
    return out.select(*series.columns, *asked)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_rows_met_by_index_are_those_of_left_joins(odd, both_ways):
    keys, asked = ["tree", "id"], {"one": (F.col("t_idx") - 1, "value"), "far": (F.col("t_idx") + 2, "extra")}
    assert rows(P.met_by_index(odd, keys, "t_idx", asked)) == rows(by_joins(odd, keys, asked))


def test_an_empty_series_is_met_by_nothing(odd):
    assert P.met_by_index(odd.limit(0), ["tree", "id"], "t_idx", {"one": (F.col("t_idx"), "value")}).collect() == []


def test_mass_of_packed_series_is_that_of_the_join(odd, spark):
    volumes = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 4.0), ("c", None, 5.0)], "tree string, id bigint, volume_ml double")
    want = odd.join(volumes, ["tree", "id"]).withColumn("mass_mg", F.col("value") * F.col("volume_ml"))
    got = S.segment_mass(odd, volumes)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_no_series_is_broadcast(make, spark):
    """Spark takes an exploded series for as small as the table it came from."""
    segs = make([(i, i // 2, 0.0, 0.0, 0.0, 1.0, float(i), 0.0, 0.01) for i in range(1, 400)]).localCheckpoint()
    long = S.time_table(segs.select("tree", "id", "radius_mm"), 41, 0.0, 0.1).withColumn("value", F.col("radius_mm"))
    for df in (S.uniform_step(long, ["tree", "id"]), S.delayed(long, ["tree", "id"], F.lit(0.15), 0.0, 0.1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan
    shown = report.display_rows(segs, long, 4.0, 20, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in shown
