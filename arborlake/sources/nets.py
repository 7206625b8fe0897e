"""Control-net surface files: blocks of a name, two counts, two knot vectors and control points."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.plans.cut import cut
from arborlake.plans.running import as_of, cumulative, neighbour
from arborlake.sources.lines import numbered

# Headings of the format.
U_HEAD, V_HEAD, P_HEAD = "U Knot Vector", "V Knot Vector", "Control Points"


def parse_nets(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(surfaces, knots, control_points) from numbered lines (file, pos, value).

    A line belongs to the last heading before it, found by an as-of lookup, so a
    large file is not walked in one task.  Blocks without counts are skipped.
    """
    text = cut(lines.select("file", "pos", F.trim("value").alias("value")), "net")
    ahead = neighbour(neighbour(text, ["file"], "pos", 1, ["value"], "_1"), ["file"], "pos", 2, ["value"], "_2")
    is_name = (F.col("value") != "") & F.coalesce(F.col("_1value").contains(":M"), F.lit(False)) & F.coalesce(F.col("_2value").contains(":N"), F.lit(False))
    kind = (
        F.when(is_name, "name").when(F.col("value") == U_HEAD, "u").when(F.col("value") == V_HEAD, "v")
        .when(F.col("value") == P_HEAD, "p").when(F.col("value") == "", "blank")
    )

    def count_of(c: str):
        return F.trim(F.split_part(F.col(c), F.lit(":"), F.lit(1))).try_cast("int")

    marks = cut(ahead.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "file", "pos", "kind", F.col("value").alias("name"), count_of("_1value").alias("m"), count_of("_2value").alias("n")), "marks")
    named = cumulative(marks, ["file"], "pos", weight=(F.col("kind") == "name").cast("int")).withColumnRenamed("upto", "block").drop("total")
    heads = named.where("kind = 'name'").select("file", "block", F.col("name").alias("surface"), "m", "n")
    sections = named.where("block > 0").join(heads.drop("m", "n"), ["file", "block"]).join(heads.select("file", "block", F.col("m").alias("_m"), F.col("n").alias("_n")), ["file", "block"])
    samples = sections.select("file", "pos", F.struct("kind", "surface", F.col("_m").alias("m"), F.col("_n").alias("n")).alias("s"))
    placed = as_of(text.where(F.col("value") != ""), samples, ["file"], "pos", "s").where(F.col("prev_t").isNotNull() & (F.col("prev_t") < F.col("pos")))
    rows = cut(placed.select("file", "value", F.col("prev_v.kind").alias("kind"), F.col("prev_v.surface").alias("surface"),
                             F.col("prev_v.m").alias("m"), F.col("prev_v.n").alias("n"), (F.col("pos") - F.col("prev_t")).alias("k")), "rows")
    surfaces = heads.select("surface", "m", "n")
    knots = rows.where("kind IN ('u', 'v')").select("surface", F.col("kind").alias("dir"), F.col("k").cast("int").alias("idx"), F.col("value").cast("double").alias("value"))
    cells = F.split("value", ",")
    bad = F.raise_error(F.concat(F.lit("not a control point: "), F.col("value"))).cast("array<string>")
    points = rows.where((F.col("kind") == "p") & (F.col("k") <= F.col("m") * F.col("n"))).withColumn("_c", F.when(F.size(cells) == 3, cells).otherwise(bad))
    points = points.select("surface", (F.floor((F.col("k") - 1) / F.col("n")) + 1).cast("int").alias("row"), ((F.col("k") - 1) % F.col("n") + 1).cast("int").alias("col"),
                           *[F.trim(F.get("_c", F.lit(i))).cast("double").alias(a) for i, a in enumerate("xyz")])
    short = surfaces.join(points.groupBy("surface").agg(F.count("*").alias("_k")), "surface", "left").where(
        F.coalesce("_k", F.lit(0)) != F.col("m") * F.col("n")).select("surface").take(1)
    if short:
        raise ValueError(f"control points missing in {short[0][0]}")
    return surfaces, knots, points


def read_nets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_nets(numbered(spark, path))


def _number(x, digits: int):
    fixed = F.format_string(f"%.{digits}f", F.when(F.abs(x) < 10.0**-digits, F.lit(0.0)).otherwise(x))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def net_lines(surfaces: DataFrame, knots: DataFrame, points: DataFrame) -> DataFrame:
    """(surface, part, k, value): the text lines of control nets; sort by these columns to print them."""
    def line(df: DataFrame, part: int, k, value) -> DataFrame:
        return df.select("surface", F.lit(part).alias("part"), k.cast("int").alias("k"), value.alias("value"))

    zero = F.lit(0)
    point = F.concat_ws(",", *[_number(F.col(a), 9) for a in "xyz"])
    sized = points.join(surfaces.select("surface", "n"), "surface")
    parts = [
        line(surfaces, 0, zero, F.col("surface")),
        line(surfaces, 1, zero, F.concat(F.col("m").cast("string"), F.lit(" :M"))),
        line(surfaces, 2, zero, F.concat(F.col("n").cast("string"), F.lit(" :N"))),
        line(surfaces, 3, zero, F.lit(U_HEAD)),
        line(knots.where("dir = 'u'"), 4, F.col("idx"), _number(F.col("value"), 6)),
        line(surfaces, 5, zero, F.lit(V_HEAD)),
        line(knots.where("dir = 'v'"), 6, F.col("idx"), _number(F.col("value"), 6)),
        line(surfaces, 7, zero, F.lit(P_HEAD)),
        line(sized, 8, (F.col("row") - 1) * F.col("n") + F.col("col"), point),
        line(surfaces, 9, zero, F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_nets(surfaces: DataFrame, knots: DataFrame, points: DataFrame, path: str, original: str | None = None) -> None:
    """Control nets as text, after the blocks of an original file or folder when one is given.

    Part files are in order: read them by name to get the file back.
    """
    lines = net_lines(surfaces, knots, points)
    if original is not None:
        kept = numbered(lines.sparkSession, original).select(
            F.concat(F.lit(""), F.col("file")).alias("surface"), F.lit(-1).alias("part"), F.col("pos").alias("k"), "value")
        kept = kept.withColumn("surface", F.concat(F.lit("\u0000"), F.col("surface")))
        lines = kept.unionByName(lines.withColumn("k", F.col("k").cast("bigint")))
    lines.repartitionByRange("surface", "part", "k").sortWithinPartitions("surface", "part", "k").select("value").write.text(path)
