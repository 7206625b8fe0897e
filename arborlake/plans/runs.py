"""Runs of rows with a single child, contracted into one row each.

A level loop that goes row by row down a tree takes as many rounds as the tree is deep.  Rows that are the only child of
their parent need no round of their own: ``single_runs`` finds the runs by pointer doubling and gives each run its level
in the tree of runs, so a loop takes one round for each branching on the way down, and a run is handled in one go.
"""

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.plans.cut import cut, cut_counted
from arborlake.plans.hierarchy import add, first, path_fold

LONGEST = 100_000  # rows of one piece; a longer run goes on in the next level


def single_runs(segs: DataFrame, carry: list[str] = (), longest: int = LONGEST, sums: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(tree, id, parent_id, carry..., run, pos, piece, up_run, up_piece, level), written, and the number of levels.

    ``sums`` adds running sums over the rows of a run after its first.
    ``run`` is the id of the topmost row of a run, ``pos`` counts from 1.  A piece hangs on the last row of piece
    ``up_piece`` of ``up_run``, which is one level up; those of level 0 hang on nothing.  Rows that hang on no root do
    not appear.
    """
    parent = F.when(F.col("parent_id") > 0, F.col("parent_id"))
    kids = segs.where(F.col("parent_id") > 0).groupBy("tree", "parent_id").agg(F.count("*").alias("_kids"))
    linked = segs.select("tree", "id", parent.alias("parent_id"), *carry).join(kids, ["tree", "parent_id"], "left")
    linked = linked.withColumn("_ptr", F.when(F.col("_kids") == 1, F.col("parent_id")))
    linked = linked.withColumns({n: F.when(F.col("_ptr").isNull(), 0.0).otherwise(c) for n, c in (sums or {}).items()})
    folds = [first("run", F.col("id")), add("pos", F.lit(1)), *[add(n, F.col(n)) for n in sums or {}]]
    rows = path_fold(linked, ["tree"], "id", "_ptr", folds, carry=["parent_id", *carry])
    rows = cut(rows.withColumn("piece", F.floor((F.col("pos") - 1) / longest).cast("int")), "members")
    sizes = rows.groupBy("tree", "run").agg((F.max("piece") + 1).alias("pieces"))
    tops = rows.where("pos = 1").select("tree", "run", "parent_id")
    up = rows.select("tree", F.col("id").alias("parent_id"), F.col("run").alias("up_run"))
    heads = cut(tops.join(sizes, ["tree", "run"]).join(up, ["tree", "parent_id"], "left"), "heads")
    reached = path_fold(heads.select("tree", F.col("run").alias("id"), "up_run", "pieces"), ["tree"], "id", "up_run", [add("upto", F.col("pieces"))])
    reached = reached.select("tree", F.col("id").alias("run"), "upto")
    above = heads.select("tree", F.col("run").alias("up_run"), F.col("pieces").alias("up_pieces"))
    placed = heads.join(reached, ["tree", "run"]).join(above, ["tree", "up_run"], "left")
    start = placed.select("tree", "run", (F.col("upto") - F.col("pieces")).alias("_start"), F.col("up_run").alias("_up"), (F.col("up_pieces") - 1).alias("_up_piece"))
    inner = F.col("piece") > 0
    out = rows.join(start, ["tree", "run"]).select(
        "tree", "id", "parent_id", *carry, *(sums or {}), "run", "pos", "piece",
        F.when(inner, F.col("run")).otherwise(F.col("_up")).alias("up_run"), F.when(inner, F.col("piece") - 1).otherwise(F.col("_up_piece")).cast("int").alias("up_piece"),
        (F.col("_start") + F.col("piece")).cast("int").alias("level"))
    out, tally = cut_counted(out, "runs", levels=F.coalesce(F.max("level") + 1, F.lit(0)))
    return out, tally["levels"]


def by_level(rows: DataFrame) -> DataFrame:
    """Rows (tree, run, level, ...) written in order of their levels, so that reading one level skips the rest."""
    return cut(rows.repartitionByRange("level", "tree", "run").sortWithinPartitions("level"), "levels")
