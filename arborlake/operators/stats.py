"""Measurements of trees and tests against reference tables.

Group keys hold ``tree`` where results are per tree.  Parameter tables are
fixed, a few dozen rows, and therefore broadcast.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import distributions, morphometry
from arborlake.functions.vectors import clamp, dot, norm, sub, triple
from arborlake.operators import trees
from arborlake.plans.cut import cut
from arborlake.plans.running import cumulative, lower_median


def with_artery(segs: DataFrame, default: str = "RCA", override: dict[str, str] | None = None) -> DataFrame:
    return segs.withColumn("artery", morphometry.artery_of(F.col("tree"), default, override))


def class_order(segs: DataFrame, params: DataFrame, name: str = "strahler_order") -> DataFrame:
    """Order of every segment from the diameter bounds of its artery."""
    bounds = params.groupBy("artery").agg(F.sort_array(F.collect_list("lower_bound_um")).alias("_bounds"))
    d = F.col("radius_mm") * 2000
    order = F.size(F.filter("_bounds", lambda b: d >= b)) - 1
    joined = with_artery(segs).join(F.broadcast(bounds), "artery")
    return joined.withColumn(name, order).drop("_bounds")


def forest_totals(segs: DataFrame) -> DataFrame:
    """Segments per tree and in all; the total row has no tree."""
    return segs.rollup("tree").agg(F.count("*").alias("n_segments"), F.count_distinct("tree").alias("n_trees"))


def junction_counts(segs: DataFrame) -> DataFrame:
    kinds = trees.with_children(segs).groupBy("tree").agg(
        F.count_if("is_terminal").alias("terminals"),
        F.count_if(F.col("junction_type") == "bifurcation").alias("bifurcations"),
        F.count_if(F.col("junction_type") == "trifurcation").alias("trifurcations"),
    )
    junctions = F.col("bifurcations") + F.col("trifurcations")
    return kinds.withColumn(
        "trifurcation_pct", F.when(junctions > 0, F.col("trifurcations") / junctions * 100).otherwise(F.lit(0.0))
    )


def order_counts(segs: DataFrame, order_col: str = "strahler_order") -> DataFrame:
    return segs.where(F.col(order_col) >= 0).groupBy("tree", F.col(order_col).alias("ord")).agg(F.count("*").alias("n"))


def order_statistics(elements: DataFrame) -> DataFrame:
    """Mean, sample sd (0 for one row) and count of element diameter and length per order."""
    return elements.where("ord >= 0").groupBy("tree", "ord").agg(
        F.avg("mean_d_um").alias("mean_d"),
        F.coalesce(F.stddev_samp("mean_d_um"), F.lit(0.0)).alias("sd_d"),
        F.avg("length_um").alias("mean_l"),
        F.coalesce(F.stddev_samp("length_um"), F.lit(0.0)).alias("sd_l"),
        F.count("*").alias("n"),
    )


def length_spread(segs: DataFrame, order_col: str = "strahler_order") -> DataFrame:
    """Minimum, lower median and mean length per order."""
    rows = segs.select("tree", F.col(order_col).alias("ord"), "length_mm")
    simple = rows.groupBy("tree", "ord").agg(F.min("length_mm").alias("min_l"), F.avg("length_mm").alias("mean_l"))
    return simple.join(lower_median(rows, ["tree", "ord"], "length_mm", "median_l"), ["tree", "ord"])


def segments_per_element(elements: DataFrame, params: DataFrame) -> DataFrame:
    """Mean number of segments per element by order and its error against the reference."""
    measured = elements.where("ord >= 0").groupBy("tree", "ord").agg(F.avg("n_segments").alias("measured"))
    ref = F.broadcast(params.select("artery", "ord", F.col("se_ratio").alias("reference")))
    joined = with_artery(measured).join(ref, ["artery", "ord"])
    error = F.abs(F.col("measured") - F.col("reference")) / F.greatest(F.col("reference"), F.lit(1e-10))
    return joined.withColumn("ratio_error", error).drop("artery")


def connectivity_counts(segs: DataFrame, order_col: str = "strahler_order") -> DataFrame:
    """Child counts by (child order, parent order) over two- and three-way junctions."""
    typed = trees.with_children(segs)
    edges = trees.parent_child(typed, [order_col, "n_children"], [order_col])
    kept = edges.where((F.col("p_n_children") >= 2) & (F.col(f"p_{order_col}") >= 0) & (F.col(f"c_{order_col}") >= 0))
    return kept.groupBy(
        "tree", F.col(f"c_{order_col}").alias("child_order"), F.col(f"p_{order_col}").alias("parent_order")
    ).agg(F.count("*").cast("double").alias("value"))


def _element_edges(segs: DataFrame, order_col: str) -> tuple[DataFrame, DataFrame]:
    """Edges between different elements, and the element table."""
    tagged = cut(segs.join(trees.elements(segs, order_col), ["tree", "id"]), "tagged")
    table = tagged.groupBy("tree", "element_id").agg(
        F.first(order_col).alias("ord"),
        F.count("*").alias("n_segments"),
        F.avg(F.col("radius_mm") * 2000).alias("mean_d_um"),
        F.sum(F.col("length_mm") * 1000).alias("length_um"),
    )
    edges = trees.parent_child(tagged, ["element_id"], ["element_id"])
    return edges.where(F.col("p_element_id") != F.col("c_element_id")), cut(table, "elements")


def element_connectivity(segs: DataFrame, order_col: str = "strahler_order") -> DataFrame:
    """Mean daughters of each order per parent element that has any daughter."""
    edges, table = _element_edges(segs, order_col)
    return _element_matrix(edges, table)


def _element_matrix(edges: DataFrame, table: DataFrame) -> DataFrame:
    orders = table.select("tree", "element_id", "ord")
    ranked = edges.join(
        orders.select("tree", F.col("element_id").alias("p_element_id"), F.col("ord").alias("parent_order")),
        ["tree", "p_element_id"],
    ).join(
        orders.select("tree", F.col("element_id").alias("c_element_id"), F.col("ord").alias("child_order")),
        ["tree", "c_element_id"],
    ).where("parent_order >= 0 AND child_order >= 0")
    # Per parent element first, so that no distinct count is needed afterwards.
    per_parent = ranked.groupBy("tree", "parent_order", "p_element_id").agg(F.lit(1).alias("_one"))
    parents = per_parent.groupBy("tree", "parent_order").agg(F.sum("_one").alias("n_parents"))
    pairs = ranked.groupBy("tree", "child_order", "parent_order").agg(F.count("*").alias("n_children"))
    return pairs.join(parents, ["tree", "parent_order"]).select(
        "tree", "child_order", "parent_order", (F.col("n_children") / F.col("n_parents")).alias("value")
    )


def connectivity_chi_square(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """Chi-square per tree of an observed matrix against the reference shares of each parent order."""
    ref = reference.where("rate > 0").select("artery", "child_order", "parent_order", "rate")
    ref_sums = ref.groupBy("artery", "parent_order").agg(F.sum("rate").alias("ref_sum"))
    shares = ref.join(ref_sums, ["artery", "parent_order"]).select(
        "artery", "child_order", "parent_order", (F.col("rate") / F.col("ref_sum")).alias("share")
    )
    obs = with_artery(observed)
    totals = obs.groupBy("tree", "artery", "parent_order").agg(F.sum("value").alias("seen")).where("seen > 0")
    cells = totals.join(F.broadcast(shares), ["artery", "parent_order"]).withColumn(
        "expected", F.col("share") * F.col("seen")
    ).where("expected >= 0.5")
    met = cells.join(obs.select("tree", "child_order", "parent_order", "value"),
                     ["tree", "child_order", "parent_order"], "left")
    diff = F.coalesce("value", F.lit(0.0)) - F.col("expected")
    out = met.groupBy("tree").agg(
        F.sum(diff * diff / F.col("expected")).alias("chi2"),
        F.greatest(F.count("*") - 1, F.lit(1)).cast("int").alias("dof"),
    )
    return out.withColumn("p_value", distributions.chi_square_tail(F.col("chi2"), F.col("dof")))


def matrix_audit(matrix: DataFrame, keys: list[str], value: str = "value", orders: Column | None = None) -> DataFrame:
    """Column sums of connectivity matrices and the rules they should keep.

    ``orders`` is the number of orders; the top two are excused from having the
    sub-diagonal as the largest entry.
    """
    columns = matrix.groupBy(*keys, "parent_order").agg(
        F.sum(value).alias("col_sum"),
        F.max(value).alias("col_max"),
        F.coalesce(F.max(F.when(F.col("child_order") == F.col("parent_order") - 1, F.col(value))), F.lit(0.0)).alias("sub"),
    ).where("parent_order >= 1")
    top = F.max("parent_order") + 1 if orders is None else F.max(orders)
    packed = columns.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("parent_order", "col_sum", "col_max", "sub"))).alias("_c"), top.alias("_n")
    )
    return packed.select(
        *keys,
        F.transform("_c", lambda c: c["col_sum"]).alias("column_sums"),
        F.forall("_c", lambda c: c["col_sum"] >= 1.9).alias("sums_reach_two"),
        F.forall("_c", lambda c: (c["parent_order"] > 5) | (c["col_sum"] <= 4)).alias("low_sums_at_most_four"),
        F.forall(
            "_c", lambda c: (c["parent_order"] > F.greatest(F.col("_n") - 3, F.lit(1))) | (c["sub"] >= c["col_max"] - 1e-10)
        ).alias("sub_diagonal_leads"),
    )


def ks_one_sample(df: DataFrame, keys: list[str], value: str, cdf: Callable[[Column], Column], min_rows: int = 1) -> DataFrame:
    """Largest gap between the empirical and a given distribution function per group, with its p-value.

    Repeated values are counted first: within a run of ties the gap is largest at its ends.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    run = cumulative(counted, keys, value, weight=F.col("_c"))
    f = cdf(F.col(value))
    gap = F.greatest(
        F.abs(F.col("upto") / F.col("total") - f), F.abs((F.col("upto") - F.col("_c")) / F.col("total") - f)
    )
    # The function may use columns that are constant per group, so it is evaluated before grouping.
    out = run.withColumn("_gap", gap).groupBy(*keys).agg(
        F.first("total").alias("n"), F.max("_gap").alias("d"), (F.sum(F.col(value) * F.col("_c")) / F.first("total")).alias("mean")
    )
    return out.where(F.col("n") >= min_rows).withColumn("p", distributions.kolmogorov_p(F.col("n"), F.col("d")))


def ks_per_order(rows: DataFrame, params: DataFrame, value: str, mean: str, sd: str) -> DataFrame:
    """KS of a value per (tree, ord) against the normal law of the reference; small or flat groups are skipped."""
    ref = F.broadcast(params.select("artery", "ord", F.col(mean).alias("_m"), F.col(sd).alias("_s")).where("_s > 0"))
    joined = with_artery(rows).join(ref, ["artery", "ord"])
    out = ks_one_sample(
        joined.select("tree", "ord", "_m", "_s", value), ["tree", "ord", "_m", "_s"], value,
        lambda x: distributions.normal_cdf((x - F.col("_m")) / F.col("_s")), min_rows=5,
    )
    return out.withColumnRenamed("_m", "reference").drop("_s")


def asymmetry(segs: DataFrame) -> DataFrame:
    """Smaller over larger daughter radius at two-way junctions."""
    edges = trees.parent_child(trees.with_children(segs), ["n_children"], ["radius_mm"])
    two = edges.where("p_n_children = 2")
    return two.groupBy("tree", F.col("parent_id").alias("id")).agg(
        (F.min("c_radius_mm") / F.max("c_radius_mm")).alias("ratio")
    )


def element_asymmetry(segs: DataFrame, order_col: str = "strahler_order") -> DataFrame:
    """Daughter over parent element diameter, one row per daughter."""
    edges, table = _element_edges(segs, order_col)
    return _diameter_ratios(edges, table)


def _diameter_ratios(edges: DataFrame, table: DataFrame) -> DataFrame:
    d = table.select("tree", "element_id", "mean_d_um")
    return (
        edges.join(d.select("tree", F.col("element_id").alias("p_element_id"), F.col("mean_d_um").alias("p_d")),
                   ["tree", "p_element_id"])
        .join(d.select("tree", F.col("element_id").alias("c_element_id"), F.col("mean_d_um").alias("c_d")),
              ["tree", "c_element_id"])
        .where("p_d > 0")
        .select("tree", (F.col("c_d") / F.col("p_d")).alias("ratio"))
    )


def branch_angles(segs: DataFrame) -> DataFrame:
    """Angle between the two daughters of every two-way junction."""
    vec = F.struct(*[(F.col(f"d{a}") - F.col(f"p{a}")).alias(a) for a in "xyz"])
    kids = trees.with_children(segs).withColumn("v", vec)
    edges = trees.parent_child(kids, ["n_children"], ["v"]).where("p_n_children = 2")
    pair = edges.groupBy("tree", F.col("parent_id").alias("id")).agg(
        F.min_by("c_v", "child_id").alias("a"), F.max_by("c_v", "child_id").alias("b")
    )
    a, b = triple("x", "y", "z", of="a"), triple("x", "y", "z", of="b")
    lengths = norm(a) * norm(b)
    return pair.where(lengths > 0).select("tree", "id", F.acos(clamp(dot(a, b) / lengths, -1.0, 1.0)).alias("angle"))


def power_law_deviation(segs: DataFrame, gamma: float) -> DataFrame:
    """|r^g - sum of daughter r^g| / r^g at two- and three-way junctions."""
    edges = trees.parent_child(trees.with_children(segs), ["n_children", "radius_mm"], ["radius_mm"])
    own = F.pow(F.first("p_radius_mm"), gamma)
    return edges.where("p_n_children >= 2").groupBy("tree", F.col("parent_id").alias("id")).agg(
        (F.abs(own - F.sum(F.pow("c_radius_mm", gamma))) / own).alias("deviation")
    )


def closest_branch_ratio(segs: DataFrame) -> DataFrame:
    """Shortest daughter length over the parent's circumference."""
    edges = trees.parent_child(trees.with_children(segs), ["n_children", "radius_mm"], ["length_mm"])
    return edges.where("p_n_children >= 2 AND p_radius_mm > 0").groupBy("tree", F.col("parent_id").alias("id")).agg(
        (F.min("c_length_mm") / (2 * 3.141592653589793 * F.first("p_radius_mm"))).alias("lambda")
    )


def _long(df: DataFrame, values: dict[str, Column], order: Column | None = None) -> DataFrame:
    """Report rows (tree, metric, ord, value) from one row per tree (and order)."""
    pairs = [F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()]
    order = F.lit(None).cast("int") if order is None else order.cast("int")
    return df.select("tree", order.alias("ord"), F.inline(F.array(*pairs))).select("tree", "metric", "ord", "value")


def tree_report(segs: DataFrame, params: DataFrame, reference: DataFrame, gamma: float) -> DataFrame:
    """All single measurements of a forest as one long table."""
    ranked = cut(class_order(segs, params), "report")
    d_um = ranked.withColumns({"d_um": F.col("radius_mm") * 2000, "ord": F.col("strahler_order")}).drop("artery")
    ks = ks_per_order(d_um.select("tree", "ord", "d_um"), params, "d_um", "d_mean", "d_sd")
    ratio = F.when(F.col("radius_mm") > 0, F.col("length_mm") / (2 * F.col("radius_mm"))).otherwise(F.lit(0.0))
    ld = ranked.groupBy("tree").agg(
        F.count("*").alias("n"), F.avg(ratio).alias("m"), F.coalesce(F.stddev_samp(ratio), F.lit(0.0)).alias("s"))
    angles = branch_angles(ranked).groupBy("tree").agg(
        F.avg("angle").alias("m"), F.coalesce(F.stddev_samp("angle"), F.lit(0.0)).alias("s"))
    power = power_law_deviation(ranked, gamma).groupBy("tree").agg(
        F.max("deviation").alias("max"), F.avg("deviation").alias("mean"))
    lam = closest_branch_ratio(ranked).groupBy("tree").agg(F.avg("lambda").alias("m"), F.min("lambda").alias("lo"))
    median = lower_median(asymmetry(ranked), ["tree"], "ratio", "m")
    chi = connectivity_chi_square(connectivity_counts(ranked), reference)
    parts = [
        _long(ks, {"diameter_ks_p": F.col("p")}, F.col("ord")),
        _long(ld, {"n_segments": F.col("n"), "ld_mean": F.col("m"), "ld_sd": F.col("s")}),
        _long(angles, {"angle_mean": F.col("m"), "angle_sd": F.col("s")}),
        _long(power, {"power_law_max": F.col("max"), "power_law_mean": F.col("mean")}),
        _long(lam, {"lambda_mean": F.col("m"), "lambda_min": F.col("lo")}),
        _long(median, {"asymmetry_median": F.col("m")}),
        _long(junction_counts(ranked), {
            "bifurcations": F.col("bifurcations"), "trifurcations": F.col("trifurcations"),
            "trifurcation_pct": F.col("trifurcation_pct")}),
        _long(chi, {"connectivity_chi2": F.col("chi2"), "connectivity_p": F.col("p_value")}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _half_pass(per_order: DataFrame, metric: str, ok: Column) -> DataFrame:
    """A metric that holds when at least half of its orders hold."""
    counted = per_order.groupBy("tree").agg(F.count_if(ok).alias("hits"), F.count("*").alias("of"))
    passed = F.col("hits") >= F.greatest(F.lit(1), F.ceil(F.col("of") * 0.5))
    return counted.select("tree", F.lit(metric).alias("metric"), (F.col("hits") / F.col("of")).alias("value"), passed.alias("passed"))


def report_card(segs: DataFrame, params: DataFrame, reference: DataFrame, gamma: float) -> DataFrame:
    """Nine pass or fail metrics per tree; ``strahler_order`` of the input is used for the runs of metric 7 only.

    Rows (tree, metric, value, passed, grade); metrics that cannot be measured have no row.
    """
    given = cut(segs, "given")
    se = segments_per_element(trees.element_table(given), params)
    ranked = cut(class_order(given.drop("strahler_order"), params).drop("artery"), "ranked")
    edges, table = _element_edges(ranked, "strahler_order")
    table_a = with_artery(table)
    n_orders = F.broadcast(params.groupBy("artery").agg(
        F.count("*").alias("n_orders"), F.sum(F.greatest("element_count", F.lit(0.0))).alias("target_all")))
    ref_d = F.broadcast(params.select("artery", "ord", F.col("d_mean_elem").alias("ref"), F.col("d_sd_elem").alias("sd")))

    means = table_a.groupBy("tree", "artery", "ord").agg(F.avg("mean_d_um").alias("mean"), F.count("*").alias("n"))
    diam = means.join(ref_d, ["artery", "ord"]).where("n >= 5 AND sd > 0")
    m1 = _half_pass(diam, "diameter_mean", F.abs(F.col("mean") - F.col("ref")) / F.col("ref") < 0.20)
    lengths = ks_per_order(table.select("tree", "ord", "length_um"), params, "length_um", "l_mean_elem", "l_sd_elem")
    m2 = _half_pass(lengths, "length_ks", F.col("p") > 0.05)
    chi = connectivity_chi_square(_element_matrix(edges, table), reference)
    m3 = chi.select("tree", F.lit("connectivity").alias("metric"), F.col("p_value").alias("value"),
                    (F.col("p_value") > 0.005).alias("passed"))
    ratios = _diameter_ratios(edges, table)
    median = lower_median(ratios, ["tree"], "ratio", "m").join(ratios.groupBy("tree").agg(F.count("*").alias("n")), "tree")
    m4 = median.select("tree", F.lit("asymmetry").alias("metric"), F.col("m").alias("value"),
                       ((F.col("n") < 5) | ((F.col("m") > 0.15) & (F.col("m") < 0.90))).alias("passed"))
    power = power_law_deviation(ranked, gamma).groupBy("tree").agg(F.avg("deviation").alias("value"))
    m5 = power.select("tree", F.lit("power_law").alias("metric"), "value", (F.col("value") < 0.01).alias("passed"))
    m6 = junction_counts(ranked).select(
        "tree", F.lit("trifurcation_pct").alias("metric"), F.col("trifurcation_pct").alias("value"),
        (F.col("trifurcation_pct") < 10).alias("passed"))
    m7 = _half_pass(se, "segments_per_element", F.col("ratio_error") < 0.30)
    seen = means.select("tree", "artery", "ord", F.col("n").alias("actual"))
    all_seen = seen.where("ord >= 0").groupBy("tree").agg(F.sum("actual").alias("actual_all"))
    share = (
        seen.join(F.broadcast(params.select("artery", "ord", F.col("element_count").alias("target")).where("target > 0")),
                  ["artery", "ord"])
        .join(n_orders, "artery").join(all_seen, "tree")
        .withColumn("ratio", (F.col("actual") / F.col("actual_all")) / (F.col("target") / F.col("target_all")))
    )
    m8 = _half_pass(share, "element_counts", (F.col("ratio") > 0.5) & (F.col("ratio") < 2.0))
    populated = with_artery(order_counts(ranked)).groupBy("tree", "artery").agg(F.count("*").alias("value")).join(n_orders, "artery")
    m9 = populated.select("tree", F.lit("orders_populated").alias("metric"), F.col("value").cast("double").alias("value"),
                          (F.col("value") >= F.greatest(F.lit(2), F.col("n_orders") - 1)).alias("passed"))
    rows = m1
    for m in (m2, m3, m4, m5, m6, m7, m8, m9):
        rows = rows.unionByName(m)
    rows = cut(rows, "card")
    grade = rows.groupBy("tree").agg((F.count_if("passed") / F.count("*")).alias("grade"))
    return rows.join(grade, "tree")


def bounding_boxes(points: DataFrame, keys: list[str], cols=("x", "y", "z")) -> DataFrame:
    return points.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def forest_bounds(segs: DataFrame) -> DataFrame:
    """Box of all tubes: ends widened by the radius."""
    r = F.col("radius_mm")
    return segs.agg(*[F.min(F.least(f"p{a}", f"d{a}") - r).alias(f"{a}0") for a in "xyz"],
                    *[F.max(F.greatest(f"p{a}", f"d{a}") + r).alias(f"{a}1") for a in "xyz"])


def terminal_diameters(segs: DataFrame, thresholds=(5.0, 9.0, 20.0), above: float = 9.0) -> DataFrame:
    d = F.col("radius_mm") * 2000
    leaf = trees.with_children(segs).where("is_terminal")
    return leaf.groupBy("tree").agg(
        F.min(d).alias("min_um"), F.max(d).alias("max_um"), F.avg(d).alias("mean_um"),
        *[F.avg(F.when(d < t, 100.0).otherwise(0.0)).alias(f"pct_below_{t:g}") for t in thresholds],
        F.count_if(d > above).alias("n_above"),
    )


def inside_share(segs: DataFrame, domain) -> DataFrame:
    p, d = triple("px", "py", "pz"), triple("dx", "dy", "dz")
    out_p, out_d = F.count_if(~domain.inside(p)), F.count_if(~domain.inside(d))
    n = F.count("*")
    return segs.groupBy("tree").agg(
        out_p.alias("proximal_outside"), out_d.alias("distal_outside"),
        (100.0 * (2 * n - out_p - out_d) / (2 * n)).alias("inside_pct"),
    )


def diameter_histogram(segs: DataFrame, lo: float = -0.5, hi: float = 3.8, bins: int = 39) -> DataFrame:
    """Counts in bins of equal width of log10 diameter in um."""
    b = F.width_bucket(F.log10(F.col("radius_mm") * 2000), F.lit(lo), F.lit(hi), F.lit(bins))
    return segs.groupBy("tree", b.alias("bin")).agg(F.count("*").alias("n"))


def tree_config(segs: DataFrame, targets: dict[str, int] = {}, shares: dict[str, float] = {}) -> DataFrame:
    """Start row of every tree: root place and radius, unit direction to the mean terminal end, targets by name."""
    typed = trees.with_children(segs)
    root = typed.where(~(F.coalesce("parent_id", F.lit(-1)) > 0)).select(
        "tree", "px", "py", "pz", "dx", "dy", "dz", "radius_mm")
    ends = typed.where("is_terminal").groupBy("tree").agg(
        *[F.avg(f"d{a}").alias(f"m{a}") for a in "xyz"], F.count("*").alias("n_terminals"))
    joined = root.join(ends, "tree", "left")
    p, own = triple("px", "py", "pz"), triple("dx", "dy", "dz")
    anchor = tuple(F.coalesce(f"m{a}", f"d{a}") for a in "xyz")
    far, near = sub(anchor, p), sub(own, p)
    use = norm(far) > 0
    way = tuple(F.when(use, a).otherwise(b) for a, b in zip(far, near))
    length = norm(way)
    unit = [F.when(length > 0, w / length).otherwise(F.lit(v)) for w, v in zip(way, (1.0, 0.0, 0.0))]

    def named(table, fallback):
        if not table:
            return fallback
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("tree")), fallback)

    n_trees = F.lit(1.0) / root.select(F.count("*")).scalar()
    return joined.select(
        "tree", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), F.col("radius_mm").alias("radius"),
        *[u.alias(f"dir_{a}") for u, a in zip(unit, "xyz")],
        named(targets, F.coalesce("n_terminals", F.lit(0))).alias("target"), named(shares, n_trees).alias("fraction"),
    )


def calibration_score(flows: DataFrame, targets: DataFrame) -> DataFrame:
    """Sum over trees of |flow - target| per case; ``flows`` and ``targets`` share (case, tree)."""
    return flows.join(targets, ["case", "tree"]).groupBy("case").agg(
        F.sum(F.abs(F.col("flow") - F.col("target"))).alias("score"))
