"""Hierarchy operators on segment tables keyed by (tree, id).

All trees of a forest are handled in one job; a tree that holds most of the
rows is spread like any other, because no step groups or sorts by tree alone.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.plans.cut import cut, cut_counted, discard
from arborlake.plans.hierarchy import (
    Fold, add, first, listed, path_fold, rise_series_parallel, roll_sum, roll_up, times,
)
from arborlake.plans.lookup import lookup
from arborlake.plans.running import SLICE, cumulative

KEY = ["tree", "id"]


def parent_or_null() -> Column:
    """Roots carry -1 at the file edges and null inside."""
    return F.when(F.col("parent_id") > 0, F.col("parent_id"))


def child_counts(segs: DataFrame) -> DataFrame:
    """(tree, id, n_children) for rows with children."""
    return (
        segs.where(F.col("parent_id") > 0)
        .groupBy("tree", F.col("parent_id").alias("id"))
        .agg(F.count("*").alias("n_children"))
    )


def with_children(segs: DataFrame, single_child_is_junction: bool = False) -> DataFrame:
    """Adds n_children, is_terminal and junction_type."""
    kids = child_counts(segs)
    out = segs.drop("n_children", "is_terminal", "junction_type").join(kids, KEY, "left")
    n = F.coalesce("n_children", F.lit(0))
    two = n.between(1 if single_child_is_junction else 2, 2)
    kind = F.when(two, "bifurcation").when(n == 3, "trifurcation").otherwise("none")
    return out.withColumns({"n_children": n, "is_terminal": n == 0, "junction_type": kind})


def parent_child(segs: DataFrame, parent_cols: list[str], child_cols: list[str]) -> DataFrame:
    """One row per edge: parent columns get the prefix p_, child columns the prefix c_."""
    parents = segs.select("tree", F.col("id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in parent_cols])
    kids = segs.where(F.col("parent_id") > 0).select(
        "tree", "parent_id", F.col("id").alias("child_id"), *[F.col(c).alias(f"c_{c}") for c in child_cols]
    )
    return kids.join(parents, ["tree", "parent_id"])


def children_list(segs: DataFrame) -> DataFrame:
    """(tree, id, children) with the children in slot order; at most three by the data model."""
    return (
        segs.where(F.col("parent_id") > 0)
        .groupBy("tree", F.col("parent_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("child_slot", F.col("id").alias("child")))).alias("_s"))
        .select("tree", "id", F.col("_s.child").alias("children"))
    )


def with_child_slot(segs: DataFrame) -> DataFrame:
    """Slot 1..3 of every child in id order (0 for roots)."""
    w = Window.partitionBy("tree", "parent_id").orderBy("id")
    roots = segs.where(~(F.coalesce("parent_id", F.lit(-1)) > 0)).withColumn("child_slot", F.lit(0))
    kids = segs.where(F.col("parent_id") > 0).withColumn("child_slot", F.row_number().over(w))
    return roots.unionByName(kids)


def _along_path(segs: DataFrame, folds: list[Fold]) -> DataFrame:
    return path_fold(segs.withColumn("_ptr", parent_or_null()), ["tree"], "id", "_ptr", folds)


def depths(segs: DataFrame) -> DataFrame:
    """(tree, id, depth) with the root at 0; rows that hang on no root do not appear."""
    return _along_path(segs, [add("depth", F.when(F.col("parent_id") > 0, 1).otherwise(0))])


def path_sums(segs: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums of columns from the root down to and with every row."""
    return _along_path(segs, [add(n, c) for n, c in sums.items()])


def path_lists(segs: DataFrame, value: Column, name: str = "path") -> DataFrame:
    """Array of a value from the root down to every row."""
    return _along_path(segs, [listed(name, value)])


def breadth_order(segs: DataFrame) -> DataFrame:
    """(tree, id, depth, level_rows, rank): place of every row in the parents-first order of its tree, from 1.

    Rows go by depth, then by the slots taken on the way down (roots of one tree by id).  Within a level that is the
    order in which a walk down the slots meets the rows, and a row is met after its ancestors and the subtrees of the
    earlier siblings of all of them.  So it takes neither arrays of slots nor a round per level.
    """
    found = depths(segs)
    rows = cut(segs.select(*KEY, parent_or_null().alias("parent_id"), "child_slot").join(found, KEY), "reached")
    sized = rows.join(subtree_sums(rows, {"_size": F.lit(1.0)}), KEY)
    w = Window.partitionBy("tree", "parent_id").orderBy("child_slot", "id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.round("_size").cast("bigint")).over(w), F.lit(0)) + 1
    walk = path_sums(sized.withColumn("_own", own), {"_walk": F.col("_own")})
    placed, tally = cut_counted(rows.select(*KEY, "depth").join(walk, KEY), "walk", n=F.count("*"))
    # A level may hold half of a tree, so it is numbered in slices.
    in_level = cumulative(placed, ["tree", "depth"], "_walk", plain_group=SLICE).withColumnsRenamed({"upto": "_in", "total": "level_rows"})
    sizes = placed.groupBy("tree", "depth").agg(F.count("*").alias("_n"))
    levels = cumulative(sizes, ["tree"], "depth", weight=F.col("_n")).select("tree", "depth", (F.col("upto") - F.col("_n")).alias("_above"))
    out = lookup(in_level, levels, ["tree", "depth"], tally["n"])
    return out.select(*KEY, "depth", "level_rows", (F.col("_above") + F.col("_in")).alias("rank"))


def topological_order(segs: DataFrame) -> DataFrame:
    """(tree, id, strahler_order): leaves 1, one child inherits, two equal largest children add one."""
    return roll_up(segs, ["tree"], "id", "parent_id", [], order="strahler_order")


def subtree_sums(segs: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums of columns over every row and all rows below it."""
    return roll_sum(segs, ["tree"], "id", "parent_id", sums)


def _is_leaf(segs: DataFrame) -> DataFrame:
    return with_children(segs)


def power_radii(segs: DataFrame, gamma: float) -> DataFrame:
    """(tree, id, radius_mm): leaf radii stay, r^gamma of an inner row is the sum over its children."""
    leaf = _is_leaf(segs)
    own = F.when(F.col("is_terminal"), F.pow("radius_mm", gamma)).otherwise(F.lit(0.0))
    rolled = roll_sum(leaf, ["tree"], "id", "parent_id", {"_rg": own})
    return rolled.select("tree", "id", F.pow("_rg", 1 / gamma).alias("radius_mm"))


def subtree_resistance(segs: DataFrame) -> DataFrame:
    """(tree, id, r_sub): own resistance in series with the children in parallel."""
    return roll_up(
        segs, ["tree"], "id", "parent_id", [rise_series_parallel("r_sub", F.col("resistance"))]
    ).drop("_order")


def flows_and_pressures(segs: DataFrame, root_pa: Column, terminal_pa: Column) -> DataFrame:
    """Adds r_sub, flow_m3_s, p_prox_pa, p_dist_pa from ``resistance``."""
    rolled = cut(segs.drop("r_sub", "flow_m3_s", "p_prox_pa", "p_dist_pa").join(subtree_resistance(segs), KEY), "rsub")
    # Share of the parent's flow: conductance of the branch among its siblings.
    siblings = (
        rolled.where(F.col("parent_id") > 0)
        .groupBy("tree", "parent_id")
        .agg(F.sum(1 / F.col("r_sub")).alias("_g_all"))
    )
    shared = rolled.join(siblings, ["tree", "parent_id"], "left").withColumn(
        "_share",
        F.when(F.col("parent_id") > 0, 1 / F.col("r_sub") / F.col("_g_all")).otherwise(
            (root_pa - terminal_pa) / F.col("r_sub")
        ),
    )
    flows = _along_path(shared, [times("flow_m3_s", F.col("_share"))])
    flowing = cut(rolled.join(flows, KEY), "flows")
    drops = path_sums(flowing, {"_drop": F.col("flow_m3_s") * F.col("resistance")})
    out = flowing.join(drops, KEY)
    p_dist = root_pa - F.col("_drop")
    return out.withColumns(
        {"p_prox_pa": p_dist + F.col("flow_m3_s") * F.col("resistance"), "p_dist_pa": p_dist}
    ).drop("_drop")


def elements(segs: DataFrame, order_col: str = "strahler_order") -> DataFrame:
    """(tree, id, element_id): a child continues its parent's element when it is its only child of that order."""
    edges = parent_child(segs, [order_col], [order_col])
    same = edges.where(F.col(f"p_{order_col}") == F.col(f"c_{order_col}"))
    sole = (
        same.groupBy("tree", "parent_id")
        .agg(F.count("*").alias("_n"), F.min("child_id").alias("id"))
        .where(F.col("_n") == 1)
        .select("tree", "id", F.col("parent_id").alias("_run"))
    )
    linked = cut(segs.select(*KEY).join(sole, KEY, "left"), "runs")
    return path_fold(linked, ["tree"], "id", "_run", [first("element_id", F.col("id"))])


def element_table(segs: DataFrame, order_col: str = "strahler_order") -> DataFrame:
    """One row per element: order, number of segments, mean diameter and total length in um."""
    tagged = segs.join(elements(segs, order_col), KEY)
    return tagged.groupBy("tree", "element_id").agg(
        F.first(order_col).alias("ord"),
        F.count("*").alias("n_segments"),
        F.avg(F.col("radius_mm") * 2000).alias("mean_d_um"),
        F.sum(F.col("length_mm") * 1000).alias("length_um"),
    )


def element_members(segs: DataFrame, order_col: str = "strahler_order") -> DataFrame:
    """(tree, element_id, pos, id): members in order along the run, one row each."""
    tagged = segs.join(elements(segs, order_col), KEY)
    above = tagged.select("tree", F.col("id").alias("parent_id"), F.col("element_id").alias("_pe"))
    linked = tagged.join(above, ["tree", "parent_id"], "left").withColumn(
        "_ptr", F.when(F.col("_pe") == F.col("element_id"), F.col("parent_id"))
    )
    linked = cut(linked.select("tree", "id", "element_id", "_ptr"), "members")
    return path_fold(linked, ["tree"], "id", "_ptr", [add("pos", F.lit(1))], carry=["element_id"])


def diameter_order(segs: DataFrame, max_iter: int = 20, tolerance: float = 0.01) -> DataFrame:
    """Iterative diameter-defined order (Jiang 1994): (tree, id, strahler_order, rounds).

    The state between rounds is one row of bounds per tree; the segments
    themselves are only scanned and never rewritten.
    """
    d = F.col("radius_mm") * 2000
    rows = cut(
        segs.select(*KEY, d.alias("d")).join(topological_order(segs), KEY).withColumnRenamed("strahler_order", "o0"),
        "ordered",
    )
    n_rows = rows.count()

    def by(bounds: str) -> Column:
        return F.size(F.filter(bounds, lambda b: F.col("d") >= b)) - 1

    def next_bounds(marked: DataFrame, old: Column, new: Column) -> DataFrame:
        stats = marked.groupBy("tree", new.alias("o")).agg(
            F.count("*").alias("n"),
            F.avg("d").alias("m"),
            F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("s"),
            F.sum((old != new).cast("long")).alias("moved"),
        )
        packed = stats.groupBy("tree").agg(
            F.map_from_entries(F.collect_list(F.struct("o", F.struct("m", "s")))).alias("by_order"),
            F.max("o").alias("top"),
            (F.sum("moved") / F.sum("n")).alias("moved"),
        )

        def stat(o: Column, part: str) -> Column:
            return F.coalesce(F.try_element_at("by_order", o)[part], F.lit(0.0))

        def grow(acc: Column, o: Column) -> Column:
            middle = (stat(o - 1, "m") + stat(o - 1, "s") + stat(o, "m") - stat(o, "s")) / 2
            return F.concat(acc, F.array(F.greatest(middle, F.element_at(acc, -1) + 0.001)))

        return packed.select(
            "tree",
            "moved",
            F.aggregate(F.sequence(F.lit(1), F.greatest("top", F.lit(1))), F.array(F.lit(0.0)), grow).alias("bounds"),
        )

    start = next_bounds(rows, F.col("o0"), F.col("o0"))
    state = cut(start.select("tree", F.lit(None).cast("array<double>").alias("was"), "bounds",
                             F.lit(0).alias("rounds"), F.lit(False).alias("settled")), "bounds")
    for step in range(1, max_iter + 1):
        marked = lookup(rows, state.where(~F.col("settled")), ["tree"], n_rows)
        old = F.when(F.col("was").isNull(), F.col("o0")).otherwise(by("was"))
        fresh = next_bounds(marked, old, by("bounds")).withColumnRenamed("bounds", "newer")
        merged = state.join(fresh, ["tree"], "left")
        # A tree settles when few rows moved: its present bounds then hold the answer.
        ends = ~F.col("settled") & ((F.col("moved") < tolerance) | F.lit(step == max_iter))
        state = cut(
            merged.select(
                "tree",
                F.when(F.col("settled") | ends, F.col("was")).otherwise(F.col("bounds")).alias("was"),
                F.when(F.col("settled") | ends, F.col("bounds")).otherwise(F.col("newer")).alias("bounds"),
                F.when(F.col("settled"), F.col("rounds")).otherwise(F.lit(step)).alias("rounds"),
                (F.col("settled") | ends).alias("settled"),
            ),
            "bounds",
        )
        if state.where(~F.col("settled")).isEmpty():
            break
    final = lookup(rows, state.select("tree", "bounds", "rounds"), ["tree"], n_rows)
    return final.select(*KEY, by("bounds").alias("strahler_order"), "rounds")


def recent_ancestors(segs: DataFrame, hops: int) -> DataFrame:
    """(tree, id, up): the row itself and up to ``hops`` ancestors, nearest first."""
    state = segs.select(
        *KEY, F.array("id").alias("up"), parent_or_null().alias("_next")
    )
    have = 1
    while have < hops + 1:
        # A row is met by at most 3^have rows below it, so no key is hot.
        # No more of the row above is sent than is still wanted.
        more = F.slice("up", 1, min(have, hops + 1 - have))
        above = state.select("tree", F.col("id").alias("_next"), more.alias("_more"), F.col("_next").alias("_after"))
        before, state = state, cut(
            state.join(above, ["tree", "_next"], "left").select(
                *KEY,
                F.concat("up", F.coalesce("_more", F.array().cast("array<bigint>"))).alias("up"),
                F.col("_after").alias("_next"),
            ),
            "ancestors",
        )
        discard(before)
        have *= 2
    return state.select(*KEY, F.slice("up", 1, hops + 1).alias("up"))


def hop_distance(up_a: Column, up_b: Column) -> Column:
    """Hops between two rows from their ancestor lists; null when they share none."""
    steps = F.transform(
        up_a, lambda x, i: F.when(F.array_position(up_b, x) > 0, i + F.array_position(up_b, x) - 1)
    )
    return F.array_min(steps)


def neighbourhood(segs: DataFrame, hops: int = 8) -> DataFrame:
    """(tree, start, id, hops): all rows within a number of hops over parent and child edges.

    Walks never turn back, so in a tree every row is reached once and no
    de-duplication is needed.
    """
    edge = segs.where(F.col("parent_id") > 0)
    moves = edge.select("tree", F.col("id").alias("at"), F.col("parent_id").alias("to")).unionByName(
        edge.select("tree", F.col("parent_id").alias("at"), F.col("id").alias("to"))
    )
    front = segs.select("tree", F.col("id").alias("start"), F.col("id").alias("at"), F.lit(-1).cast("long").alias("came"))
    found = [front.select("tree", "start", F.col("at").alias("id"), F.lit(0).alias("hops"))]
    for h in range(1, hops + 1):
        front = front.join(moves, ["tree", "at"]).where(F.col("to") != F.col("came"))
        front = front.select("tree", "start", F.col("to").alias("at"), F.col("at").alias("came"))
        if h % 4 == 0 and h < hops:
            front = cut(front, "walk")
        found.append(front.select("tree", "start", F.col("at").alias("id"), F.lit(h).alias("hops")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
