"""Filters, checks and trims."""

from pyspark.sql import DataFrame, functions as F

from arborlake.operators import trees
from arborlake.plans.lookup import lookup
from arborlake.plans.running import order_statistic


def radius_at_least(segs: DataFrame, min_radius_um: float) -> DataFrame:
    return segs.where(F.col("radius_mm") * 1000 >= min_radius_um)


def diameter_at_least(segs: DataFrame, min_diameter_um: float) -> DataFrame:
    return segs.where(F.col("radius_mm") * 2000 >= min_diameter_um)


def select_named(df: DataFrame, name: str, pattern: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Rows whose name matches a pattern and is in a table of names (column ``name``); both are optional."""
    if pattern is not None:
        df = df.where(F.col(name).rlike(pattern))
    if names is not None:
        df = df.join(names.select(F.col("name").alias(name)).distinct(), name, "left_semi")
    return df


def missing_names(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct wanted names that are not present."""
    return wanted.select("name").distinct().join(present.select("name").distinct(), "name", "left_anti")


def length_limit_mm(params: DataFrame, sigma=2.5, min_factor=1.5, cutoff_um=8.0) -> DataFrame:
    """(artery, ord, limit_mm): longest segment an order may grow."""
    top = F.greatest(F.col("l_mean") + sigma * F.col("l_sd"), F.col("l_mean") * min_factor, F.lit(cutoff_um * 4))
    return params.select("artery", "ord", (top / 1000).alias("limit_mm"))


def length_gate(segs: DataFrame, params: DataFrame, handoff_order: int | None = None, order_col: str = "strahler_order") -> DataFrame:
    """Adds limit_mm and fits: is the segment within the limit of its (or the handoff) order?

    ``segs`` carries ``artery`` and its order.
    """
    order = F.greatest(F.col(order_col), F.lit(max(handoff_order or 0, 0)))
    top = F.broadcast(params.groupBy("artery").agg(F.max("ord").alias("_top")))
    limits = F.broadcast(length_limit_mm(params))
    out = segs.join(top, "artery").withColumn("ord", F.least(order, F.col("_top"))).join(limits, ["artery", "ord"])
    return out.drop("_top", "ord").withColumn("fits", F.col("length_mm") <= F.col("limit_mm"))


def prune_leaves(segs: DataFrame, max_diameter_um: float = 50.0) -> DataFrame:
    """Leaves wider than the limit are removed once; the root stays, and so do parents that become leaves."""
    typed = trees.with_children(segs)
    root = ~(F.coalesce("parent_id", F.lit(-1)) > 0)
    wide = F.col("is_terminal") & (F.col("radius_mm") * 2000 > max_diameter_um)
    return typed.where(root | ~wide)


def flow_violations(segs: DataFrame, rtol: float = 1e-4) -> DataFrame:
    """(tree, id, rule) for every broken flow or pressure rule; empty when all is well."""
    own = F.filter(
        F.array(
            F.when(F.col("flow_m3_s") <= 0, "flow not positive"),
            F.when((F.col("p_prox_pa") < 0) | (F.col("p_dist_pa") < 0), "negative pressure"),
            F.when(F.col("p_prox_pa") < F.col("p_dist_pa") - 1e-6, "pressure rises"),
        ),
        lambda r: r.isNotNull(),
    )
    single = segs.select("tree", "id", F.explode(own).alias("rule"))
    edges = trees.parent_child(segs, ["flow_m3_s"], ["flow_m3_s"])
    sums = edges.groupBy("tree", F.col("parent_id").alias("id")).agg(
        F.first("p_flow_m3_s").alias("q"), F.sum("c_flow_m3_s").alias("s"), F.count("*").alias("n"))
    lost = sums.where((F.col("n") >= 2) & (F.abs(F.col("q") - F.col("s")) > rtol * F.greatest(F.abs("q"), F.abs("s"))))
    return single.unionByName(lost.select("tree", "id", F.lit("flow not kept").alias("rule")))


def trim_end_caps(points: DataFrame, min_fraction: float = 0.2) -> DataFrame:
    """Points from the first to the last radius that reaches a share of the line's median positive radius."""
    positive = points.where("radius_mm > 0").select("line", "radius_mm")
    mid = order_statistic(positive, ["line"], "radius_mm", {
        "_a": F.floor((F.col("total") + 1) / 2), "_b": F.floor(F.col("total") / 2) + 1})
    limits = mid.select("line", (min_fraction * (F.col("_a") + F.col("_b")) / 2).alias("_min"))
    n = points.count()
    marked = lookup(points, limits, ["line"], n)
    ok = F.when(F.col("radius_mm") >= F.col("_min"), F.col("pos"))
    span = marked.groupBy("line").agg(F.min(ok).alias("_from"), F.max(ok).alias("_to"))
    # Lines without a positive radius have no limit and stay whole.
    every = points.select("line").distinct().join(span, "line", "left")
    inside = F.col("_from").isNull() | F.col("pos").between(F.col("_from"), F.col("_to"))
    return lookup(points, every, ["line"], n).where(inside).drop("_from", "_to")


def trim_root_cap(points: DataFrame, min_fraction: float = 0.75, max_share: float = 0.25, keep: int = 4) -> DataFrame:
    """Drops leading points until the radius reaches a share of the line's largest, at most a quarter of them."""
    n_rows = points.count()
    whole = points.groupBy("line").agg(F.count("*").alias("_n"), (F.max("radius_mm") * min_fraction).alias("_min"))
    marked = lookup(points, whole, ["line"], n_rows)
    last = F.greatest(F.lit(1), F.least(F.col("_n") - keep + 1, F.floor(F.col("_n") * max_share) + 1))
    hit = F.when((F.col("_n") > keep) & (F.col("pos") <= last) & (F.col("radius_mm") >= F.col("_min")), F.col("pos"))
    start = marked.groupBy("line").agg(F.coalesce(F.min(hit), F.lit(1)).alias("_from"))
    return lookup(points, start, ["line"], n_rows).where(F.col("pos") >= F.col("_from")).drop("_from")


def dynamic_labels(materials: DataFrame) -> DataFrame:
    """Labels of blood and contrast materials, each once, in order."""
    low = F.lower("name")
    return materials.where(low.contains("_blood") | low.contains("iodine")).select("label").distinct().orderBy("label")
