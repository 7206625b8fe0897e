"""Registered queries: measurements and tests."""

from pyspark.sql import functions as F

from arborlake.catalog.bed import FOREST_SQL, forest, lines, LINES_SQL, sig, sig_sql, table, with_sql
from arborlake.catalog.q_trees import KIDS_SQL, flowing, FLOW_SQL
from arborlake.functions import distributions, domains, flow, geometry as g, morphometry
from arborlake.functions.vectors import as_struct, norm, sub, triple
from arborlake.operators import stats, trees

QUERIES, ORACLE = {}, {}
GAMMA = flow.GAMMA


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


# Lower diameter bounds (um) by order, from the published tables, independent of the engine's own rule.
BOUNDS_UM = {
    "RCA": (0.0, 8.815, 11.085, 15.6, 24.95, 44.7, 92.5, 194.15, 341.75, 551.85, 955.0, 2319.5),
    "LAD": (0.0, 8.63, 10.72, 15.4, 24.25, 48.2, 101.5, 217.15, 384.2, 554.05, 986.0, 2189.5),
    "LCX": (0.0, 8.63, 10.72, 15.4, 22.7, 52.05, 101.65, 202.6, 363.75, 649.4, 1782.0),
}


def _prm_sql():
    rows = []
    for artery, (orders, _) in morphometry.PRESETS.items():
        for i, (row, lb) in enumerate(zip(orders, BOUNDS_UM[artery])):
            rows.append(f"('{artery}',{i},{','.join(f'CAST({v!r} AS DOUBLE)' for v in (*row, lb))})")
    return ("prm(artery, ord, d_mean, d_sd, l_mean, l_sd, d_mean_elem, d_sd_elem, l_mean_elem, l_sd_elem, se_ratio, "
            "element_count, lower_bound_um) AS (VALUES " + ",".join(rows) + ")")


def _rate_sql():
    rows = [f"('{a}',{c},{p},CAST({r!r} AS DOUBLE))" for a, (_, rates) in morphometry.PRESETS.items()
            for p, col in rates.items() for c, r in col.items()]
    return "rate(artery, child_order, parent_order, rate) AS (VALUES " + ",".join(rows) + ")"


PRM, RATE = _prm_sql(), _rate_sql()
ORD_SQL = """ranked AS (SELECT s.tree, s.id, s.parent_id, s.radius_mm, s.length_mm, max(p.ord) AS o FROM seg s JOIN prm p
  ON p.artery = s.tree AND s.radius_mm * 2000 >= p.lower_bound_um GROUP BY ALL)"""
ELEM_SQL = """same AS (SELECT c.tree, c.parent_id, min(c.id) AS id, count(*) AS n FROM ranked c JOIN ranked p
  ON p.tree = c.tree AND p.id = c.parent_id AND p.o = c.o GROUP BY 1, 2 HAVING count(*) = 1),
tag AS (SELECT r.tree, r.id, r.id AS e FROM ranked r ANTI JOIN same s ON s.tree = r.tree AND s.id = r.id
  UNION ALL SELECT s.tree, s.id, t.e FROM tag t JOIN same s ON s.tree = t.tree AND s.parent_id = t.id),
elem AS (SELECT r.*, t.e FROM ranked r JOIN tag t ON t.tree = r.tree AND t.id = r.id),
el AS (SELECT tree, e, min(o) AS ord, count(*) AS n_segments, avg(radius_mm * 2000) AS d, sum(length_mm * 1000) AS l FROM elem GROUP BY 1, 2),
ee AS (SELECT c.tree, p.e AS pe, c.e AS ce FROM elem c JOIN elem p ON p.tree = c.tree AND p.id = c.parent_id AND p.e <> c.e)"""


def ranked(spark, sf):
    return stats.class_order(forest(spark, sf), morphometry.order_params(spark)).drop("artery")


@register("forest_totals", with_sql(FOREST_SQL, body="""SELECT tree, count(*) AS n_segments, count(DISTINCT tree) AS n_trees
FROM seg GROUP BY ROLLUP(tree)"""))
def forest_totals(spark, sf):
    return stats.forest_totals(forest(spark, sf))


@register("junction_and_terminal_counts", with_sql(FOREST_SQL, KIDS_SQL, body="""
SELECT tree, count(*) FILTER (n_children = 0) AS terminals, count(*) FILTER (n_children = 2) AS bifurcations,
 count(*) FILTER (n_children = 3) AS trifurcations, round(CASE WHEN count(*) FILTER (n_children >= 2) > 0 THEN
 count(*) FILTER (n_children = 3) * 100.0 / count(*) FILTER (n_children >= 2) ELSE 0 END, 6) AS trifurcation_pct FROM top GROUP BY 1"""))
def junctions(spark, sf):
    return stats.junction_counts(forest(spark, sf)).withColumn("trifurcation_pct", F.round("trifurcation_pct", 6))


@register("children_and_junction_kind", with_sql(FOREST_SQL, KIDS_SQL, """
ch AS (SELECT tree, parent_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS children FROM seg WHERE parent_id > 0 GROUP BY 1, 2)""", body="""
SELECT t.tree, t.id, coalesce(children, '') AS children, CASE n_children WHEN 2 THEN 'bifurcation' WHEN 3 THEN 'trifurcation' ELSE 'none' END AS kind,
 CASE WHEN n_children BETWEEN 1 AND 2 THEN 'bifurcation' WHEN n_children = 3 THEN 'trifurcation' ELSE 'none' END AS kind_when_added
FROM top t LEFT JOIN ch c ON c.tree = t.tree AND c.id = t.id"""))
def children(spark, sf):
    segs = trees.with_child_slot(forest(spark, sf))
    kinds = trees.with_children(segs).select("tree", "id", F.col("junction_type").alias("kind"), "n_children")
    added = F.when(F.col("n_children").between(1, 2), "bifurcation").otherwise(F.col("kind"))
    return kinds.join(trees.children_list(segs), ["tree", "id"], "left").select(
        "tree", "id", F.array_join(F.coalesce("children", F.array().cast("array<bigint>")), ",").alias("children"), "kind",
        added.alias("kind_when_added"))


@register("order_by_diameter_bounds_and_counts", with_sql(FOREST_SQL, PRM, ORD_SQL, body="""
SELECT tree, o AS ord, count(*) AS n FROM ranked WHERE o >= 0 GROUP BY 1, 2"""))
def order_counts(spark, sf):
    return stats.order_counts(ranked(spark, sf))


@register("element_runs", with_sql(FOREST_SQL, PRM, ORD_SQL, ELEM_SQL, recursive=True, body=f"""
SELECT tree, e AS element_id, ord, n_segments, {sig_sql('d')} AS mean_d_um, {sig_sql('l')} AS length_um FROM el"""))
def element_runs(spark, sf):
    return trees.element_table(ranked(spark, sf)).select(
        "tree", "element_id", "ord", "n_segments", sig(F.col("mean_d_um")).alias("mean_d_um"), sig(F.col("length_um")).alias("length_um"))


@register("element_member_positions", with_sql(FOREST_SQL, PRM, ORD_SQL, ELEM_SQL, """
pos AS (SELECT tree, id, e, 1 AS pos FROM elem WHERE id = e UNION ALL
  SELECT c.tree, c.id, c.e, p.pos + 1 FROM pos p JOIN elem c ON c.tree = p.tree AND c.parent_id = p.id AND c.e = p.e)""", recursive=True,
  body="SELECT tree, e AS element_id, id, pos FROM pos"))
def element_members(spark, sf):
    return trees.element_members(ranked(spark, sf)).select("tree", "element_id", "id", "pos")


@register("element_statistics_per_order", with_sql(FOREST_SQL, PRM, ORD_SQL, ELEM_SQL, recursive=True, body=f"""
SELECT tree, ord, {sig_sql('avg(d)', 8)} AS mean_d, round(coalesce(stddev_samp(d), 0), 6) AS sd_d, {sig_sql('avg(l)', 8)} AS mean_l,
 round(coalesce(stddev_samp(l), 0), 3) AS sd_l, count(*) AS n FROM el GROUP BY 1, 2"""))
def element_statistics(spark, sf):
    s = stats.order_statistics(trees.element_table(ranked(spark, sf)))
    return s.select("tree", "ord", sig(F.col("mean_d"), 8).alias("mean_d"), F.round("sd_d", 6).alias("sd_d"),
                    sig(F.col("mean_l"), 8).alias("mean_l"), F.round("sd_l", 3).alias("sd_l"), "n")


@register("length_spread_per_order", with_sql(FOREST_SQL, PRM, ORD_SQL, body="""
SELECT tree, o AS ord, round(min(length_mm), 6) AS min_l, round(quantile_disc(length_mm, 0.5), 6) AS median_l, round(avg(length_mm), 6) AS mean_l
FROM ranked GROUP BY 1, 2"""))
def length_spread(spark, sf):
    return stats.length_spread(ranked(spark, sf)).select("tree", "ord", *[F.round(c, 6).alias(c) for c in ("min_l", "median_l", "mean_l")])


@register("segments_per_element", with_sql(FOREST_SQL, PRM, ORD_SQL, ELEM_SQL, recursive=True, body="""
SELECT m.tree, m.ord, round(measured, 6) AS measured, se_ratio AS reference, round(abs(measured - se_ratio) / greatest(se_ratio, 1e-10), 6) AS ratio_error
FROM (SELECT tree, ord, avg(n_segments) AS measured FROM el GROUP BY 1, 2) m JOIN prm p ON p.artery = m.tree AND p.ord = m.ord"""))
def se_ratios(spark, sf):
    s = stats.segments_per_element(trees.element_table(ranked(spark, sf)), morphometry.order_params(spark))
    return s.select("tree", "ord", F.round("measured", 6).alias("measured"), "reference", F.round("ratio_error", 6).alias("ratio_error"))


CONN_SQL = """nk AS (SELECT tree, parent_id, count(*) AS n FROM seg WHERE parent_id > 0 GROUP BY 1, 2),
conn AS (SELECT c.tree, c.o AS child_order, p.o AS parent_order, CAST(count(*) AS DOUBLE) AS value FROM ranked c JOIN ranked p
  ON p.tree = c.tree AND p.id = c.parent_id JOIN nk ON nk.tree = p.tree AND nk.parent_id = p.id AND nk.n >= 2 GROUP BY 1, 2, 3)"""


@register("connectivity_counts", with_sql(FOREST_SQL, PRM, ORD_SQL, CONN_SQL, body="SELECT * FROM conn"))
def connectivity(spark, sf):
    return stats.connectivity_counts(ranked(spark, sf))


EL_CONN = """ecn AS (SELECT ee.tree, c.ord AS child_order, p.ord AS parent_order, count(*) AS n, ANY_VALUE(k.np) AS np FROM ee
  JOIN el c ON c.tree = ee.tree AND c.e = ee.ce JOIN el p ON p.tree = ee.tree AND p.e = ee.pe
  JOIN (SELECT ee.tree, p.ord, count(DISTINCT ee.pe) AS np FROM ee JOIN el p ON p.tree = ee.tree AND p.e = ee.pe GROUP BY 1, 2) k
  ON k.tree = ee.tree AND k.ord = p.ord GROUP BY 1, 2, 3),
conn AS (SELECT tree, child_order, parent_order, n / np AS value FROM ecn)"""


@register("element_connectivity", with_sql(FOREST_SQL, PRM, ORD_SQL, ELEM_SQL, EL_CONN, recursive=True, body="""
SELECT tree, child_order, parent_order, round(value, 8) AS value FROM conn"""))
def element_connectivity(spark, sf):
    return stats.element_connectivity(ranked(spark, sf)).withColumn("value", F.round("value", 8))


CHI_SQL = """ref AS (SELECT artery, child_order, parent_order, rate / sum(rate) OVER (PARTITION BY artery, parent_order) AS share FROM rate),
tot AS (SELECT tree, parent_order, sum(value) AS seen FROM conn GROUP BY 1, 2),
cel AS (SELECT t.tree, r.share * t.seen AS ex, coalesce(c.value, 0) AS ob FROM tot t JOIN ref r ON r.artery = t.tree AND r.parent_order = t.parent_order
  LEFT JOIN conn c ON c.tree = t.tree AND c.parent_order = t.parent_order AND c.child_order = r.child_order WHERE r.share * t.seen >= 0.5),
chi AS (SELECT tree, sum(pow(ob - ex, 2) / ex) AS chi2, CAST(greatest(count(*) - 1, 1) AS INTEGER) AS dof FROM cel GROUP BY 1),
ser AS (SELECT *, CASE WHEN dof % 2 = 0 THEN list_sum([exp(i * ln(chi2 / 2) - lgamma(i + 1) - chi2 / 2) FOR i IN range(0, dof // 2)])
  ELSE list_sum([exp((i - 0.5) * ln(chi2 / 2) - lgamma(i + 0.5) - chi2 / 2) FOR i IN range(1, (dof - 1) // 2 + 1)]) END AS s FROM chi)"""
CHI_P = f"coalesce(s, 0) + CASE WHEN dof % 2 = 1 THEN 2 * (1 - {distributions.normal_cdf_sql('sqrt(chi2)')}) ELSE 0 END"


@register("connectivity_chi_square", with_sql(FOREST_SQL, PRM, RATE, ORD_SQL, CONN_SQL, CHI_SQL, body=f"""
SELECT tree, {sig_sql('chi2')} AS chi2, dof, round({CHI_P}, 8) AS p_value FROM ser"""))
def chi_square(spark, sf):
    s = stats.connectivity_chi_square(stats.connectivity_counts(ranked(spark, sf)), morphometry.connectivity(spark))
    return s.select("tree", sig(F.col("chi2")).alias("chi2"), "dof", F.round("p_value", 8).alias("p_value"))


@register("element_connectivity_chi_square", with_sql(FOREST_SQL, PRM, RATE, ORD_SQL, ELEM_SQL, EL_CONN, CHI_SQL, recursive=True, body=f"""
SELECT tree, {sig_sql('chi2')} AS chi2, dof, round({CHI_P}, 8) AS p_value FROM ser"""))
def element_chi_square(spark, sf):
    s = stats.connectivity_chi_square(stats.element_connectivity(ranked(spark, sf)), morphometry.connectivity(spark))
    return s.select("tree", sig(F.col("chi2")).alias("chi2"), "dof", F.round("p_value", 8).alias("p_value"))


@register("connectivity_matrix_audit", with_sql(FOREST_SQL, PRM, ORD_SQL, ELEM_SQL, EL_CONN, """
cols AS (SELECT tree, parent_order, sum(value) AS s, max(value) AS m, coalesce(max(CASE WHEN child_order = parent_order - 1 THEN value END), 0) AS sub
  FROM conn WHERE parent_order >= 1 GROUP BY 1, 2),
nn AS (SELECT tree, max(parent_order) + 1 AS n FROM cols GROUP BY 1)""", recursive=True, body="""
SELECT c.tree, string_agg(printf('%.5f', s), ';' ORDER BY parent_order) AS column_sums, bool_and(s >= 1.9) AS sums_reach_two,
 bool_and(parent_order > 5 OR s <= 4) AS low_sums_at_most_four, bool_and(parent_order > greatest(n - 3, 1) OR sub >= m - 1e-10) AS sub_diagonal_leads
FROM cols c JOIN nn ON nn.tree = c.tree GROUP BY 1"""))
def audit(spark, sf):
    a = stats.matrix_audit(stats.element_connectivity(ranked(spark, sf)), ["tree"])
    sums = F.array_join(F.transform("column_sums", lambda v: F.format_string("%.5f", v)), ";")
    return a.withColumn("column_sums", sums)


KS_P = """CASE WHEN lam <= 0 THEN 1.0 WHEN lam > 3.1 THEN 0.0 ELSE least(greatest(2*exp(-2*lam*lam)-2*exp(-8*lam*lam)+2*exp(-18*lam*lam)-2*exp(-32*lam*lam),0.0),1.0) END"""


def _ks_sql(src, value, mean, sd):
    z = f"((v - p.{mean}) / p.{sd})"
    return f"""x AS (SELECT tree, ord, {value} AS v, row_number() OVER (PARTITION BY tree, ord ORDER BY {value}) AS i,
  count(*) OVER (PARTITION BY tree, ord) AS n FROM {src}),
z AS (SELECT x.tree, x.ord, n, i, v, p.{mean} AS reference, {distributions.normal_cdf_sql(z)} AS f FROM x JOIN prm p ON p.artery = x.tree AND p.ord = x.ord
  WHERE p.{sd} > 0 AND n >= 5),
ks AS (SELECT tree, ord, min(n) AS n, any_value(reference) AS reference, avg(v) AS mean, max(greatest(abs(i / n - f), abs((i - 1) / n - f))) AS d FROM z GROUP BY 1, 2),
kl AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM ks)"""


@register("ks_diameter_per_order", with_sql(FOREST_SQL, PRM, ORD_SQL, "src AS (SELECT tree, o AS ord, radius_mm * 2000 AS v0 FROM ranked)",
          _ks_sql("src", "v0", "d_mean", "d_sd"), body=f"""
SELECT tree, ord, n, reference, round(mean, 6) AS mean, round(d, 7) AS d, round({KS_P}, 7) AS p FROM kl"""))
def ks_diameters(spark, sf):
    rows = ranked(spark, sf).select("tree", F.col("strahler_order").alias("ord"), (F.col("radius_mm") * 2000).alias("d_um"))
    ks = stats.ks_per_order(rows, morphometry.order_params(spark), "d_um", "d_mean", "d_sd")
    return ks.select("tree", "ord", "n", "reference", F.round("mean", 6).alias("mean"), F.round("d", 7).alias("d"), F.round("p", 7).alias("p"))


@register("ks_element_length_per_order", with_sql(FOREST_SQL, PRM, ORD_SQL, ELEM_SQL, _ks_sql("el", "l", "l_mean_elem", "l_sd_elem"), recursive=True, body=f"""
SELECT tree, ord, n, round(d, 7) AS d, round({KS_P}, 7) AS p FROM kl"""))
def ks_lengths(spark, sf):
    rows = trees.element_table(ranked(spark, sf)).select("tree", "ord", "length_um")
    ks = stats.ks_per_order(rows, morphometry.order_params(spark), "length_um", "l_mean_elem", "l_sd_elem")
    return ks.select("tree", "ord", "n", F.round("d", 7).alias("d"), F.round("p", 7).alias("p"))


PAIR_SQL = """pair AS (SELECT s.tree, s.parent_id AS id, min(s.radius_mm) AS lo, max(s.radius_mm) AS hi, count(*) AS n, min(s.length_mm) AS len0,
  sum(pow(s.radius_mm, %r)) AS rg, arg_min(s.id, s.id) AS c1, arg_max(s.id, s.id) AS c2 FROM seg s WHERE parent_id > 0 GROUP BY 1, 2)""" % GAMMA


@register("sibling_asymmetry_median", with_sql(FOREST_SQL, PAIR_SQL, body=f"""
SELECT tree, count(*) AS n, {sig_sql('quantile_disc(lo / hi, 0.5)')} AS median FROM pair WHERE n = 2 GROUP BY 1"""))
def asymmetry(spark, sf):
    from arborlake.plans.running import order_statistic

    med = order_statistic(stats.asymmetry(forest(spark, sf)), ["tree"], "ratio", {"m": F.floor((F.col("total") + 1) / 2)})
    return med.select("tree", F.col("total").alias("n"), sig(F.col("m")).alias("median"))


@register("element_asymmetry_median", with_sql(FOREST_SQL, PRM, ORD_SQL, ELEM_SQL, recursive=True, body=f"""
SELECT ee.tree, count(*) AS n, {sig_sql('quantile_disc(c.d / p.d, 0.5)', 8)} AS median FROM ee JOIN el c ON c.tree = ee.tree AND c.e = ee.ce
JOIN el p ON p.tree = ee.tree AND p.e = ee.pe GROUP BY 1"""))
def element_asymmetry(spark, sf):
    from arborlake.plans.running import order_statistic

    med = order_statistic(stats.element_asymmetry(ranked(spark, sf)), ["tree"], "ratio", {"m": F.floor((F.col("total") + 1) / 2)})
    return med.select("tree", F.col("total").alias("n"), sig(F.col("m"), 8).alias("median"))


@register("branch_angles", with_sql(FOREST_SQL, PAIR_SQL, """
ang AS (SELECT p.tree, p.id, a.dx-a.px AS ax, a.dy-a.py AS ay, a.dz-a.pz AS az, b.dx-b.px AS bx, b.dy-b.py AS by_, b.dz-b.pz AS bz,
  a.length_mm * b.length_mm AS ll FROM pair p JOIN seg a ON a.tree = p.tree AND a.id = p.c1 JOIN seg b ON b.tree = p.tree AND b.id = p.c2 WHERE p.n = 2),
aa AS (SELECT tree, acos(least(greatest((ax*bx+ay*by_+az*bz)/ll, -1.0), 1.0)) AS a FROM ang WHERE ll > 0)""", body="""
SELECT tree, count(*) AS n, round(avg(a), 7) AS mean_angle, round(coalesce(stddev_samp(a), 0), 7) AS sd_angle FROM aa GROUP BY 1"""))
def angles(spark, sf):
    return stats.branch_angles(forest(spark, sf)).groupBy("tree").agg(
        F.count("*").alias("n"), F.round(F.avg("angle"), 7).alias("mean_angle"),
        F.round(F.coalesce(F.stddev_samp("angle"), F.lit(0.0)), 7).alias("sd_angle"))


@register("power_law_deviation", with_sql(FOREST_SQL, PAIR_SQL, f"""
dv AS (SELECT s.tree, abs(pow(s.radius_mm, {GAMMA!r}) - p.rg) / pow(s.radius_mm, {GAMMA!r}) AS v FROM pair p JOIN seg s ON s.tree = p.tree AND s.id = p.id
  WHERE p.n >= 2)""", body=f"SELECT tree, {sig_sql('max(v)')} AS max_deviation, {sig_sql('avg(v)')} AS mean_deviation FROM dv GROUP BY 1"))
def deviation(spark, sf):
    return stats.power_law_deviation(forest(spark, sf), GAMMA).groupBy("tree").agg(
        sig(F.max("deviation")).alias("max_deviation"), sig(F.avg("deviation")).alias("mean_deviation"))


@register("closest_branch_ratio", with_sql(FOREST_SQL, PAIR_SQL, body=f"""
SELECT s.tree, s.id, {sig_sql('p.len0 / (2 * pi() * s.radius_mm)')} AS lambda FROM pair p JOIN seg s ON s.tree = p.tree AND s.id = p.id WHERE p.n >= 2"""))
def branch_ratio(spark, sf):
    return stats.closest_branch_ratio(forest(spark, sf)).select("tree", "id", sig(F.col("lambda")).alias("lambda"))


@register("tree_report")
def tree_report(spark, sf):
    rep = stats.tree_report(forest(spark, sf), morphometry.order_params(spark), morphometry.connectivity(spark), GAMMA)
    return rep.withColumn("value", sig(F.col("value"), 7))


@register("report_card")
def report_card(spark, sf):
    segs = forest(spark, sf)
    given = segs.join(trees.topological_order(segs), ["tree", "id"])
    card = stats.report_card(given, morphometry.order_params(spark), morphometry.connectivity(spark), GAMMA)
    return card.select("tree", "metric", sig(F.col("value"), 7).alias("value"), "passed", F.round("grade", 6).alias("grade"))


@register("forest_bounding_box", with_sql(FOREST_SQL, body=", ".join(
    [f"{'SELECT ' if i == 0 else ''}round(min(least(p{a}, d{a}) - radius_mm), 6) AS {a}0, round(max(greatest(p{a}, d{a}) + radius_mm), 6) AS {a}1"
     for i, a in enumerate("xyz")]) + " FROM seg"))
def bounds(spark, sf):
    b = stats.forest_bounds(forest(spark, sf))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@register("line_boxes_and_centres", with_sql(LINES_SQL, body="SELECT line, " + ", ".join(
    f"round(min({a}), 6) AS {a}_min, round(max({a}), 6) AS {a}_max, round(avg({a}), 9) AS {a}_mean" for a in "xyz") + " FROM ln GROUP BY line"))
def line_boxes(spark, sf):
    b = stats.bounding_boxes(lines(spark, sf), ["line"])
    return b.select("line", *[F.round(c, 9 if c.endswith("mean") else 6).alias(c) for c in b.columns if c != "line"])


@register("terminal_diameter_shares", with_sql(FOREST_SQL, KIDS_SQL, body=f"""
SELECT tree, {sig_sql('min(radius_mm*2000)')} AS min_um, {sig_sql('max(radius_mm*2000)')} AS max_um, {sig_sql('avg(radius_mm*2000)')} AS mean_um,
 round(avg(CASE WHEN radius_mm*2000 < 20 THEN 100.0 ELSE 0 END), 6) AS pct_below_20, round(avg(CASE WHEN radius_mm*2000 < 50 THEN 100.0 ELSE 0 END), 6) AS pct_below_50,
 count(*) FILTER (radius_mm*2000 > 9) AS n_above FROM top WHERE n_children = 0 GROUP BY 1"""))
def terminal_shares(spark, sf):
    t = stats.terminal_diameters(forest(spark, sf), (20.0, 50.0))
    return t.select("tree", *[sig(F.col(c)).alias(c) for c in ("min_um", "max_um", "mean_um")],
                    *[F.round(c, 6).alias(c) for c in ("pct_below_20", "pct_below_50")], "n_above")


BALL = domains.Sphere((50.0, 50.0, 50.0), 55.0)


@register("share_inside_domain", with_sql(FOREST_SQL, """io AS (SELECT tree,
  NOT (pow(px-50,2)+pow(py-50,2)+pow(pz-50,2) <= 55*55) AS op, NOT (pow(dx-50,2)+pow(dy-50,2)+pow(dz-50,2) <= 55*55) AS od FROM seg)""", body="""
SELECT tree, count(*) FILTER (op) AS proximal_outside, count(*) FILTER (od) AS distal_outside,
 round(100.0 * (2*count(*) - count(*) FILTER (op) - count(*) FILTER (od)) / (2*count(*)), 6) AS inside_pct FROM io GROUP BY 1"""))
def inside_share(spark, sf):
    return stats.inside_share(forest(spark, sf), BALL).withColumn("inside_pct", F.round("inside_pct", 6))


@register("diameter_histogram", with_sql(FOREST_SQL, body="""
SELECT tree, CAST(floor((log10(radius_mm*2000) + 0.5) / 4.3 * 39) + 1 AS BIGINT) AS bin, count(*) AS n FROM seg GROUP BY 1, 2"""))
def histogram(spark, sf):
    return stats.diameter_histogram(forest(spark, sf))


@register("tree_config_from_terminals", with_sql(FOREST_SQL, KIDS_SQL, """
ends AS (SELECT tree, avg(dx) AS mx, avg(dy) AS my, avg(dz) AS mz, count(*) AS nt FROM top WHERE n_children = 0 GROUP BY 1),
cf AS (SELECT s.tree, s.px AS x, s.py AS y, s.pz AS z, s.radius_mm AS radius, mx - s.px AS ux, my - s.py AS uy, mz - s.pz AS uz, nt FROM seg s JOIN ends e ON e.tree = s.tree WHERE s.id = 1)""",
 body=f"""SELECT tree, x, y, z, radius, {', '.join(f'round(u{a} / sqrt(ux*ux+uy*uy+uz*uz), 9) AS dir_{a}' for a in 'xyz')}, nt AS target,
 CASE tree WHEN 'LAD' THEN 0.40 WHEN 'LCX' THEN 0.25 ELSE 0.35 END::DOUBLE AS fraction FROM cf"""))
def config(spark, sf):
    c = stats.tree_config(forest(spark, sf), shares={"LAD": 0.40, "LCX": 0.25, "RCA": 0.35})
    return c.select("tree", "x", "y", "z", "radius", *[F.round(f"dir_{a}", 9).alias(f"dir_{a}") for a in "xyz"],
                    F.col("target").cast("bigint").alias("target"), "fraction")
