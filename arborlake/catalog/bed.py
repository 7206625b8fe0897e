"""Forests, lines, points and series derived from the driver's tables, in Spark and as SQL text.

The rule for the forest: three rooted trees over the order keys, one binary,
one ternary, one with runs of single children.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.functions.vectors import norm, sub, triple

NAMES = ("LAD", "LCX", "RCA")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sig(x: Column, digits: int = 9) -> Column:
    """Rounded to significant digits: float sums differ in the last places between engines."""
    return F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double")


def sig_sql(x: str, digits: int = 9) -> str:
    return f"CAST(printf('%.{digits - 1}e', CAST({x} AS DOUBLE)) AS DOUBLE)"


def _place(i: Column, t: Column) -> tuple[Column, Column, Column]:
    return (
        ((i * 37 + t * 11) % 1009) / 10.0,
        ((i * 73) % 1013) / 10.0,
        ((i * 101) % 1019) / 10.0,
    )


def forest(spark: SparkSession, sf: str) -> DataFrame:
    """Long segments: each starts at its parent's end."""
    t, i = F.col("t"), F.col("id")
    base = table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 3).alias("t"),
        (F.floor(F.col("o_orderkey") / 3) + 1).alias("id"),
        "o_totalprice",
    )
    parent = (
        F.when(i == 1, F.lit(-1))
        .when(t == 0, F.floor(i / 2))
        .when(t == 1, F.floor((i + 1) / 3))
        .when(i % 2 == 0, F.floor(i / 2))
        .otherwise(i - 1)
    )
    base = base.withColumn("parent_id", parent.cast("bigint"))
    distal = _place(i, t)
    up = _place(F.col("parent_id"), t)
    start = tuple(F.when(i == 1, F.lit(0.0)).otherwise(v) for v in up)
    cols = dict(zip(("px", "py", "pz"), start)) | dict(zip(("dx", "dy", "dz"), distal))
    segs = base.withColumns(cols)
    names = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (t + 1).cast("int"))
    return segs.select(
        names.alias("tree"),
        "id",
        "parent_id",
        "px", "py", "pz", "dx", "dy", "dz",
        (0.004 + F.col("o_totalprice") / 1e7).alias("radius_mm"),
        norm(sub(triple("dx", "dy", "dz"), triple("px", "py", "pz"))).alias("length_mm"),
    )


FOREST_SQL = """
raw AS (SELECT o_orderkey % 3 AS t, o_orderkey // 3 + 1 AS id, o_totalprice FROM orders),
rooted AS (SELECT *, CASE WHEN id = 1 THEN -1 WHEN t = 0 THEN id // 2 WHEN t = 1 THEN (id + 1) // 3
                          WHEN id % 2 = 0 THEN id // 2 ELSE id - 1 END AS parent_id FROM raw),
placed AS (SELECT t, id, parent_id, o_totalprice,
   CASE WHEN id = 1 THEN 0.0 ELSE ((parent_id*37 + t*11) % 1009) / 10.0 END AS px,
   CASE WHEN id = 1 THEN 0.0 ELSE ((parent_id*73) % 1013) / 10.0 END AS py,
   CASE WHEN id = 1 THEN 0.0 ELSE ((parent_id*101) % 1019) / 10.0 END AS pz,
   ((id*37 + t*11) % 1009) / 10.0 AS dx, ((id*73) % 1013) / 10.0 AS dy, ((id*101) % 1019) / 10.0 AS dz
   FROM rooted),
seg AS (SELECT CASE t WHEN 0 THEN 'LAD' WHEN 1 THEN 'LCX' ELSE 'RCA' END AS tree, id, parent_id,
   px, py, pz, dx, dy, dz, 0.004 + o_totalprice / 1e7 AS radius_mm,
   sqrt((dx-px)*(dx-px) + (dy-py)*(dy-py) + (dz-pz)*(dz-pz)) AS length_mm FROM placed)"""


def twigs(spark: SparkSession, sf: str) -> DataFrame:
    """Short segments of the same forest for spatial work: from each row's end, about one mm long."""
    segs = forest(spark, sf)
    i = F.col("id")
    return segs.select(
        "tree", "id", "parent_id",
        F.col("dx").alias("px"), F.col("dy").alias("py"), F.col("dz").alias("pz"),
        (F.col("dx") + (i % 7 - 3) * 0.2).alias("dx"),
        (F.col("dy") + (i % 5 - 2) * 0.2).alias("dy"),
        (F.col("dz") + (i % 3 - 1) * 0.4).alias("dz"),
        "radius_mm",
    ).withColumn("length_mm", norm(sub(triple("dx", "dy", "dz"), triple("px", "py", "pz"))))


TWIGS_SQL = FOREST_SQL + """,
twig0 AS (SELECT tree, id, parent_id, dx AS px, dy AS py, dz AS pz, dx + (id % 7 - 3) * 0.2 AS ex,
          dy + (id % 5 - 2) * 0.2 AS ey, dz + (id % 3 - 1) * 0.4 AS ez, radius_mm FROM seg),
twig AS (SELECT tree, id, parent_id, px, py, pz, ex AS dx, ey AS dy, ez AS dz, radius_mm,
         sqrt((ex-px)*(ex-px) + (ey-py)*(ey-py) + (ez-pz)*(ez-pz)) AS length_mm FROM twig0)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Query points from the first three vector entries."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("qid"),
        *[(50 + 120 * e[k].cast("double")).alias(n) for k, n in enumerate(("x", "y", "z"))],
    )


POINTS_SQL = """pt AS (SELECT vec_id AS qid, 50 + 120 * CAST(embedding[1] AS DOUBLE) AS x,
  50 + 120 * CAST(embedding[2] AS DOUBLE) AS y, 50 + 120 * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Polylines: one per order key, points by a total order of its items."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line"),
        F.row_number().over(w).alias("pos"),
        (F.col("l_quantity") / 10).alias("x"),
        (F.col("l_extendedprice") / 10000).alias("y"),
        (F.col("l_tax") * 50).alias("z"),
        (0.2 + F.col("l_discount") * 20).alias("radius_mm"),
    )


LINES_SQL = """ln AS (SELECT l_orderkey AS line, row_number() OVER (PARTITION BY l_orderkey
   ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos, l_quantity / 10 AS x,
   l_extendedprice / 10000 AS y, l_tax * 50 AS z, 0.2 + l_discount * 20 AS radius_mm FROM lineitem)"""


def with_sql(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c.strip() for c in ctes) + "\n" + body
