"""Running totals and ranks that do not put a whole group into one task.

A plain window sorts a group in one task.  Here the rows are written once; only when they, or the largest group of them,
are few is the plain window used.  Otherwise a two-pass prefix scan runs over the written rows: they are dealt out by
ranges of (key, value, ties, row number), so that even rows with one value in all columns are split, each range sums up
its rows, and the totals of the earlier ranges of a group are added as an offset.  No edge of a range is held in the plan.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.plans.cut import cut, cut_counted

SLICE = 65_536  # rows of one slice of an integer position
PLAIN_GROUP = 2_000_000  # groups up to this size fit one task with ease


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the columns of ``left``, then those ``right`` adds."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column], slice_rows: int = SLICE) -> DataFrame:
    """Inclusive running sums along an integer position (from 1, without gaps)."""
    longest = df.agg(F.max(pos)).first()[0] or 0
    if longest <= slice_rows:
        w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    parts = {f"_p_{n}": c for n, c in sums.items()}
    sliced = cut(df.withColumns(parts).withColumn("_slice", F.floor((F.col(pos) - 1) / slice_rows)), "slices")
    inner = Window.partitionBy(*keys, "_slice").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(*[F.sum(p).alias(p) for p in parts])
        .select(*keys, "_slice", *[F.coalesce(F.sum(p).over(before), F.lit(0.0)).alias(f"_b{p}") for p in parts])
    )
    inside = sliced.withColumns({f"_i{p}": F.sum(p).over(inner) for p in parts})
    joined = matched(inside, offsets, [*keys, "_slice"])
    return joined.withColumns({n: F.col(f"_i_p_{n}") + F.col(f"_b_p_{n}") for n in sums}).drop(
        "_slice", *parts, *[f"_i{p}" for p in parts], *[f"_b{p}" for p in parts]
    )


def _written(df: DataFrame, keys: list[str], plain_group: int, label: str) -> tuple[DataFrame, bool]:
    """``df`` written with a row number, and whether every group is small enough for a plain window.

    The rows are counted by the write; sizes of groups are looked up, from the key columns alone, only when all rows
    together are too many for one group.
    """
    table, seen = cut_counted(df.withColumn("_row", F.monotonically_increasing_id()), label, n=F.count(F.lit(1)))
    if (seen["n"] or 0) <= plain_group:
        return table, True
    if not keys:
        return table, False
    return table, table.groupBy(*keys).count().agg(F.max("count")).first()[0] <= plain_group


def ranges(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a written table dealt out by ranges of (keys, order, row number), written with the number of the range.

    The order of ``_part`` agrees with that of the rows.  Spark samples the edges; the row number makes every row
    differ, so no value or key is too frequent to be split.
    """
    dealt = table.repartitionByRange(*[F.col(c) for c in [*keys, *order, "_row"]])
    return cut(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def cumulative(
    df: DataFrame, keys: list[str], value: str, ties: list[str] = (), weight: Column | None = None, plain_group: int = PLAIN_GROUP,
) -> DataFrame:
    """Adds ``upto`` (weight of rows up to and with this one in order of value, ties) and ``total`` per group."""
    weight = F.lit(1) if weight is None else weight
    kept, order = df.columns, [value, *ties]
    table, plain = _written(df.withColumn("_w", weight), keys, plain_group, "ordered")
    if plain:
        whole = Window.partitionBy(*keys)
        run = whole.orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
        return table.withColumns({"upto": F.sum("_w").over(run), "total": F.sum("_w").over(whole)}).select(*kept, "upto", "total")
    parts = ranges(table, keys, order)
    inner = Window.partitionBy(*keys, "_part").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(*keys, "_part").agg(F.sum("_w").alias("_sw")).select(
        *keys, "_part", F.coalesce(F.sum("_sw").over(earlier), F.lit(0)).alias("_before"), F.sum("_sw").over(group).alias("total"))
    inside = parts.withColumn("_in", F.sum("_w").over(inner))
    return matched(inside, offsets, [*keys, "_part"]).withColumn("upto", F.col("_in") + F.col("_before")).select(*kept, "upto", "total")


def order_statistic(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Values at given ranks (from 1) per group; a rank Column may use ``total``."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    run = cumulative(distinct, keys, value, weight=F.col("_c"))
    return run.groupBy(*keys).agg(
        *[F.min(F.when(F.col("upto") >= r, F.col(value))).alias(n) for n, r in ranks.items()],
        F.first("total").alias("total"),
    )


RANGES = 4096  # ranges of keys that are counted together


def first_rows(table: DataFrame, key: str, n: int, ranges: int = RANGES) -> DataFrame:
    """The ``n`` rows of a written table with the smallest integer keys, which no two rows share; all if there are fewer.

    The rows are counted by range of the key, then within the range that holds the n-th one, until that is found: a few
    passes over one column, and a filter.  Nothing is sorted and no task holds the rows.
    """
    size, low, high = table.agg(F.count(key), F.min(key), F.max(key)).first()
    if size <= n:
        return table.where(F.col(key).isNotNull())
    if n <= 0:
        return table.limit(0)
    before = 0
    while True:
        width = -(-(high - low + 1) // ranges)
        counts = table.where(F.col(key).between(low, high)).groupBy(F.call_function("div", F.col(key) - low, F.lit(width)).alias("r")).count().collect()  # at most ``ranges`` rows
        for r, count in sorted(tuple(c) for c in counts):
            if before + count >= n:
                break
            before += count
        low, high = low + r * width, min(high, low + (r + 1) * width - 1)
        if width == 1:
            return table.where(F.col(key) <= low)


def lower_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Element (n + 1) div 2 of the sorted values."""
    return order_statistic(df, keys, value, {name: F.floor((F.col("total") + 1) / 2)}).drop("total")


def neighbour(df: DataFrame, keys: list[str], pos: str, offset: int, cols: list[str], prefix: str) -> DataFrame:
    """Adds the columns of the row ``offset`` positions further along (null at the ends)."""
    longest = df.agg(F.max(pos)).first()[0] or 0
    if longest <= SLICE:
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns({f"{prefix}{c}": F.lead(c, offset).over(w) if offset > 0 else F.lag(c, -offset).over(w) for c in cols})
    # (key, position) is unique, so this join has no hot key however long a line is.
    other = df.select(*keys, (F.col(pos) - offset).alias(pos), *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return matched(df, other, [*keys, pos], "left")


def as_of(
    asked: DataFrame, samples: DataFrame, keys: list[str], time: str, value: str, plain_group: int = PLAIN_GROUP,
) -> DataFrame:
    """For every asked time the last sample at or before it and the first one after it.

    Adds prev_t, prev_v, next_t, next_v.  A long series is scanned range by range of its times; the last (first) sample
    of earlier (later) ranges is carried over.
    """
    q_cols = asked.columns
    sample = F.when(~F.col("_asks"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    both = asked.withColumns({"_v": F.lit(None).cast(samples.schema[value].dataType), "_asks": F.lit(True)}).unionByName(
        samples.select(*keys, time, F.col(value).alias("_v"), F.lit(False).alias("_asks")), allowMissingColumns=True
    )
    # At equal times samples come first, so a sample at the asked time counts as the last one.
    order = [time, "_asks"]
    table, plain = _written(both.withColumn("_s", sample), keys, plain_group, "asof")
    if not plain:
        table = ranges(table, keys, order)
    part = list(keys) if plain else [*keys, "_part"]
    w = Window.partitionBy(*part).orderBy(*order, "_row")
    out = table.withColumns({
        "_prev": F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.first("_s", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    if not plain:
        at = F.when(~F.col("_asks"), F.struct(time, "_row"))
        edge = table.groupBy(*part).agg(F.max_by("_s", at).alias("_l"), F.min_by("_s", at).alias("_f"))
        o = Window.partitionBy(*keys).orderBy("_part")
        edge = edge.select(*part,
                           F.last("_l", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_cl"),
                           F.first("_f", ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing)).alias("_cf"))
        out = matched(out, edge, part).withColumns({"_prev": F.coalesce("_prev", "_cl"), "_next": F.coalesce("_next", "_cf")})
    return out.where("_asks").select(
        *q_cols, F.col("_prev.t").alias("prev_t"), F.col("_prev.v").alias("prev_v"),
        F.col("_next.t").alias("next_t"), F.col("_next.v").alias("next_v"))
