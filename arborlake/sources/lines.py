"""Text files and folders as numbered lines, without reading a file in one task."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arborlake.plans.cut import cut


def numbered(spark: SparkSession, path: str, key: str | None = None, one: bool = False) -> DataFrame:
    """(file, pos, value) with pos from 1.

    ``file`` is a file's name, or with ``key`` the value of that partition folder; the part files of one folder are
    then one text, in the order of their names.  Files are told apart by their whole path, as writers give the parts
    of all folders the same names.  With ``one`` all files below ``path`` are one text.

    A large file is read in blocks.  A row knows the start of its block, and rows
    of a block keep their order, so the number of a line is its place in the block
    plus the lines of all earlier blocks and files of its text.
    """
    raw = spark.read.text(path)
    name = F.col(key).cast("string") if key else F.col("_metadata.file_name")
    group = F.lit(path) if one else name if key else F.col("_metadata.file_path")
    raw = raw.select(
        name.alias("file"), group.alias("_text"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value")
    rows = cut(raw, "text")
    blocks = rows.groupBy("_text", "_path", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("_text").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_path", "_block", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    met = rows.join(offsets, ["_path", "_block"])
    return met.select("file", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("pos"), "value")
