"""Forest unions, display preparation and run manifests."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import geometry as g
from arborlake.functions.text import plain_name, run_stamp
from arborlake.functions.vectors import clamp, triple
from arborlake.operators import filters, ranking, series
from arborlake.plans.boxes import SMALL_LEVEL
from arborlake.plans.cut import cut_counted


def union_forest(parts: dict[str, DataFrame]) -> DataFrame:
    """Named trees as one table."""
    return reduce(DataFrame.unionByName, [df.withColumn("tree", F.lit(n)) for n, df in sorted(parts.items())])


def grown_part(segs: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rows beyond the fixed first ``n_fixed`` of their tree; trees without an entry are grown as a whole."""
    return segs.join(fixed, "tree", "left").where(F.col("id") > F.coalesce("n_fixed", F.lit(0))).drop("n_fixed")


def marker_size(radius_mm: Column, scale: float = 10.0) -> Column:
    return clamp(scale * F.sqrt(F.greatest(radius_mm, F.lit(0.0))), 1.4, 8.0)


def display_rows(segs: DataFrame, values: DataFrame, min_radius_um: float, max_rows: int, stride: int) -> DataFrame:
    """Decimated segments with every stride-th value, their midpoint, size and the largest value of all."""
    kept = ranking.decimate(filters.radius_at_least(segs, min_radius_um), ["tree"], "radius_mm", ["id"], max_rows)
    m = g.midpoint(triple("px", "py", "pz"), triple("dx", "dy", "dz"))
    shaped = kept.select(
        "tree", "id", *[v.alias(f"m{a}") for v, a in zip(m, "xyz")], "length_mm",
        (F.col("radius_mm") * 2000).alias("diameter_um"), marker_size(F.col("radius_mm")).alias("marker"))
    # Spark takes the exploded values for small, so it is told which side is: the written rows, when they are few.
    shaped, seen = cut_counted(shaped, "shaped", n=F.count(F.lit(1)))
    wanted = series.every_nth(values, stride)
    few = (seen["n"] or 0) <= SMALL_LEVEL
    rows = wanted.join(F.broadcast(shaped), ["tree", "id"]) if few else wanted.hint("merge").join(shaped, ["tree", "id"])
    return rows.withColumn("top", rows.agg(F.max("value")).scalar())


def layers(named: dict[str, DataFrame]) -> DataFrame:
    """Display layers in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn("layer", F.lit(n)) for n, df in named.items()])


def run_manifest(segs: DataFrame, times: DataFrame, voxels: DataFrame | None, run_time: Column) -> DataFrame:
    """One JSON document per run: counts per tree, time range and number of active voxels."""
    per_tree = segs.groupBy("run_ts", "tree").agg(F.count("*").alias("segments"))
    trees = per_tree.groupBy("run_ts").agg(
        F.sort_array(F.collect_list(F.struct("tree", "segments"))).alias("trees"), F.sum("segments").alias("segments"))
    span = times.groupBy("run_ts").agg(F.min("t").alias("t0"), F.max("t").alias("tend"), F.count("*").alias("n_times"))
    out = trees.join(span, "run_ts", "left")
    if voxels is not None:
        out = out.join(voxels.groupBy("run_ts").agg(F.count("*").alias("active_voxels")), "run_ts", "left")
    return out.select(run_stamp(run_time).alias("run"), F.to_json(F.struct(*[c for c in out.columns if c != "run_ts"])).alias("manifest"))


def frame_manifest(frames: DataFrame, materials: DataFrame) -> DataFrame:
    """One JSON document per frame with its label table; commas in names become underscores."""
    rows = materials.groupBy("frame").agg(
        F.sort_array(F.collect_list(F.struct("label", plain_name(F.col("name")).alias("name"), "density"))).alias("materials"))
    return frames.join(rows, "frame").select("frame", "time_s", F.to_json(F.struct("frame", "time_s", "overlay_voxels", "dynamic_labels", "materials")).alias("manifest"))
