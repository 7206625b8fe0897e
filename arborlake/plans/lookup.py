"""Many-to-one lookups that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame, functions as F

# Below this many left rows a single hot reducer is harmless and Spark's own
# join choice (plus its runtime skew split) is used.
PLAIN_ROWS = 20_000_000
# A key is hot when it holds more than 1/HOT_SHARE of the left rows, so there
# are at most HOT_SHARE hot keys and their lookup rows are safe to broadcast.
HOT_SHARE = 4096


def lookup(left: DataFrame, right: DataFrame, on: list[str], left_rows: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` where ``on`` is unique in ``right``."""
    if left_rows <= PLAIN_ROWS:
        return left.join(right, on)
    hot = left.groupBy(*on).count().where(F.col("count") > left_rows / HOT_SHARE).select(*on)
    hot_side = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
    cold_left = left.join(F.broadcast(hot), on, "left_anti")
    return left.join(hot_side, on).unionByName(cold_left.join(right, on))
