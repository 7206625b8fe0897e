"""Run snapshots, time frames and their manifests."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.functions.text import plain_name
from arborlake.operators import report

FRAME_ENTRY = "struct<time_s:double,raw_path:string,scan_path:string,overlay_voxels:bigint,dynamic_labels:bigint>"


def write_snapshot(path: str, run_ts: Column, segs: DataFrame, series: DataFrame | None = None, voxels: DataFrame | None = None) -> None:
    """Segments, series and voxels of one run below ``path``, cut by run and tree, and a manifest of the run.

    Each part lies in a folder of the run, which a repeated run replaces as a whole; the manifest comes last.
    """
    stamp = segs.select(report.run_stamp(run_ts)).first()[0]

    def save(df: DataFrame, part: str, by: list[str]) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{part}/run_ts={stamp}")
        return df.withColumn("run_ts", F.lit(stamp))

    segs = save(segs, "segments", ["tree"])
    times = segs.select("run_ts").distinct().withColumn("t", F.lit(None).cast("double"))
    if series is not None:
        times = save(series, "series", ["tree"]).select("t", "run_ts").distinct()
    if voxels is not None:
        voxels = save(voxels, "voxels", [])
    report.run_manifest(segs, times, voxels, run_ts).select("manifest").write.mode("overwrite").text(f"{path}/manifest/run_ts={stamp}")


def write_frames(path: str, frames: DataFrame, labels: DataFrame, materials: DataFrame) -> None:
    """Label volume and material table of every frame, cut by frame, with one manifest document per frame.

    ``frames`` is (frame, time_s, overlay_voxels, dynamic_labels), ``materials`` (frame, label, name, density).
    """
    labels.write.partitionBy("frame").parquet(f"{path}/labels")
    materials.withColumn("name", plain_name(F.col("name"))).write.partitionBy("frame").csv(f"{path}/materials", header=True)
    report.frame_manifest(frames, materials).select(F.col("manifest").alias("value")).write.text(f"{path}/manifest")


def frames_of(documents: DataFrame) -> DataFrame:
    """Frames of run manifests (column ``value``, one JSON document per row) in time order; an empty list is an error."""
    parsed = documents.select(F.from_json("value", f"frames array<{FRAME_ENTRY}>").alias("d"))
    empty = F.raise_error(F.lit("manifest without frames")).cast(f"array<{FRAME_ENTRY}>")
    frames = F.when(F.size("d.frames") > 0, F.col("d.frames")).otherwise(empty)
    return parsed.select(F.inline(frames)).orderBy("time_s")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests are small documents, one file each."""
    return frames_of(spark.read.text(path, wholetext=True))


def preferred_values(rows: DataFrame, prefer_hu: bool = True) -> DataFrame:
    """Adds value and unit from the columns hu and mu; both missing is an error."""
    first, second = ("hu", "mu") if prefer_hu else ("mu", "hu")
    value = F.coalesce(first, second, F.raise_error(F.lit("neither hu nor mu")).cast("double"))
    unit = F.when(F.col(first).isNotNull(), F.lit(first)).otherwise(F.lit(second))
    return rows.withColumns({"value": value, "unit": unit})
