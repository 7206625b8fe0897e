"""Top-k, even subsamples, stratified decimation and shares."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.plans.cut import cut
from arborlake.plans.running import cumulative, matched


def top_k(df: DataFrame, by: Column, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(by.desc(), *ties).limit(k)


def ranked(df: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """Adds ``upto``, the rank from 1 per group, and ``total``; large groups are ranked range by range."""
    return cumulative(df, keys, value, ties)


def spread_evenly(df: DataFrame, target: Column) -> DataFrame:
    """Rows of ``df`` (with rank ``_r`` and group size ``_n``) whose rank belongs to an even subsample of ``target``.

    A rank is picked when some i in 0..target-1 has round(1 + i * step) = rank;
    the only candidates are the i next to (rank - 1) / step, so no list is built.
    All rows are kept when there are no more than ``target``.
    """
    step = (F.col("_n") - 1) / F.greatest(target - 1, F.lit(1))
    near = F.floor((F.col("_r") - 1) / step)
    hit = F.exists(
        F.array(near - 1, near, near + 1, near + 2),
        lambda i: (i >= 0) & (i <= target - 1) & (F.bround(1 + i * step).cast("bigint") == F.col("_r")),
    )
    only = (target == 1) & (F.col("_r") == 1)
    return df.where((F.col("_n") <= target) | only | ((target > 1) & hit))


def decimate(df: DataFrame, keys: list[str], value: str, ties: list[str], target: int, large: float = 0.25, small: float = 0.45) -> DataFrame:
    """At most ``target`` rows per group: a share of the largest, a share of the smallest, the rest evenly spread.

    The strata are two bounded top-k, which every task cuts down before the shuffle; only the rows between them are
    ranked, in id order (``ties``).
    """
    n_large, n_small = max(1, round(target * large)), round(target * small) and max(1, round(target * small))
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()), "decimated")
    down = _first(rows, keys, -F.col(value), ties, n_large)
    ends = (down.union(_first(rows, keys, F.col(value), ties, n_small)).distinct() if n_small else down).withColumn("_end", F.lit(True))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    sized = matched(rows, sizes, keys) if keys else rows.withColumn("_all", sizes.select("_all").scalar())
    marked = cut(sized.join(ends, "_row", "left"), "strata").drop("_row")
    between = (F.col("_all") > target) & F.col("_end").isNull()
    spread = ranked(marked.where(between), keys, ties[0], ties[1:]).withColumnsRenamed({"upto": "_r", "total": "_n"})
    kept = spread_evenly(spread, F.lit(target - n_large - n_small)).drop("_r", "_n")
    return marked.where(~between).unionByName(kept).drop("_end", "_all")


def _first(rows: DataFrame, keys: list[str], by: Column, ties: list[str], k: int) -> DataFrame:
    """Row numbers of the first ``k`` rows per group in order of ``by``, ties."""
    w = Window.partitionBy(*keys).orderBy(by, *ties, "_row")
    return rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).select("_row")


def decimate_static(df: DataFrame, keys: list[str], value: str, ties: list[str], target: int, large: float = 0.35) -> DataFrame:
    """The same with only the largest rows as a fixed stratum."""
    return decimate(df, keys, value, ties, target, large, 0.0)


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """max(value, 0) over its sum per group; equal shares when all are zero."""
    v = F.greatest(F.col(value), F.lit(0.0))
    total = df.groupBy(*keys).agg(F.sum(v).alias("_sum"), F.count("*").alias("_cnt"))
    if keys:
        joined = df.join(total, keys)
    else:
        joined = df.withColumn("_t", total.select(F.struct("_sum", "_cnt")).scalar()).select("*", "_t.*").drop("_t")
    return joined.withColumn("share", F.when(F.col("_sum") > 0, v / F.col("_sum")).otherwise(1 / F.col("_cnt"))).drop("_sum", "_cnt")
