"""Registered queries: hierarchy operators."""

from pyspark.sql import functions as F

from arborlake.catalog.bed import FOREST_SQL, forest, sig, sig_sql, with_sql
from arborlake.functions import flow, morphometry
from arborlake.operators import trees

GAMMA = flow.GAMMA
QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


DEPTH_SQL = """dep AS (SELECT tree, id, parent_id, 0 AS depth FROM seg WHERE parent_id < 0
  UNION ALL SELECT s.tree, s.id, s.parent_id, d.depth + 1 FROM dep d JOIN seg s ON s.tree = d.tree AND s.parent_id = d.id)"""
KIDS_SQL = """kids AS (SELECT tree, parent_id AS id, count(*) AS n_children FROM seg WHERE parent_id > 0 GROUP BY 1, 2),
top AS (SELECT s.*, coalesce(k.n_children, 0) AS n_children FROM seg s LEFT JOIN kids k ON k.tree = s.tree AND k.id = s.id)"""
CLOSURE_SQL = """up AS (SELECT tree, id AS leaf, id, parent_id FROM seg
  UNION ALL SELECT u.tree, u.leaf, s.id, s.parent_id FROM up u JOIN seg s ON s.tree = u.tree AND s.id = u.parent_id)"""


@register("hierarchy_depth", with_sql(FOREST_SQL, DEPTH_SQL, recursive=True, body="SELECT tree, id, depth FROM dep"))
def hierarchy_depth(spark, sf):
    return trees.depths(forest(spark, sf)).select("tree", "id", "depth")


@register("hierarchy_breadth_first_order", with_sql(FOREST_SQL, """
kid AS (SELECT tree, id, parent_id, row_number() OVER (PARTITION BY tree, parent_id ORDER BY id) AS slot FROM seg WHERE parent_id > 0),
way AS (SELECT tree, id, 0 AS depth, [id] AS slots FROM seg WHERE parent_id < 0
  UNION ALL SELECT k.tree, k.id, w.depth + 1, list_append(w.slots, k.slot) FROM way w JOIN kid k ON k.tree = w.tree AND k.parent_id = w.id)""", recursive=True, body="""
SELECT tree, id, depth, count(*) OVER (PARTITION BY tree, depth) AS level_rows, row_number() OVER (PARTITION BY tree ORDER BY depth, slots) AS rank FROM way"""))
def breadth_first(spark, sf):
    return trees.breadth_order(trees.with_child_slot(forest(spark, sf)))


@register("hierarchy_ancestor_list_and_path_sum", with_sql(FOREST_SQL, """
path AS (SELECT tree, id, [id] AS ids, length_mm AS way FROM seg WHERE parent_id < 0
  UNION ALL SELECT s.tree, s.id, list_append(p.ids, s.id), p.way + s.length_mm FROM path p
  JOIN seg s ON s.tree = p.tree AND s.parent_id = p.id)""", recursive=True, body=f"""
SELECT tree, id, array_to_string(ids, '>') AS ids, {sig_sql('way')} AS path_mm FROM path"""))
def ancestor_list(spark, sf):
    segs = forest(spark, sf)
    from arborlake.plans.hierarchy import add, listed, path_fold

    found = path_fold(
        segs.withColumn("_ptr", trees.parent_or_null()), ["tree"], "id", "_ptr",
        [listed("ids", F.col("id")), add("way", F.col("length_mm"))],
    )
    return found.select("tree", "id", F.array_join("ids", ">").alias("ids"), sig(F.col("way")).alias("path_mm"))


LEVEL_UP = """dmax AS (SELECT max(depth) AS d FROM dep),
node AS (SELECT s.*, d.depth FROM seg s JOIN dep d ON d.tree = s.tree AND d.id = s.id)"""


@register("hierarchy_strahler_order", with_sql(FOREST_SQL, DEPTH_SQL, LEVEL_UP, """
rise AS (SELECT tree, id, parent_id, depth, 1 AS o FROM node, dmax WHERE depth = d
  UNION ALL
  SELECT n.tree, n.id, n.parent_id, n.depth, CASE WHEN k.m IS NULL THEN 1 WHEN k.c >= 2 THEN k.m + 1 ELSE k.m END
  FROM (SELECT DISTINCT depth AS lv FROM rise) l JOIN node n ON n.depth = l.lv - 1
  LEFT JOIN (SELECT tree, parent_id, max(o) AS m, count(*) FILTER (o = mo) AS c
             FROM (SELECT *, max(o) OVER (PARTITION BY tree, parent_id) AS mo FROM rise) GROUP BY 1, 2) k
  ON k.tree = n.tree AND k.parent_id = n.id)""", recursive=True,
  body="SELECT tree, id, o AS strahler_order FROM rise"))
def strahler(spark, sf):
    return trees.topological_order(forest(spark, sf)).select("tree", "id", "strahler_order")


@register("hierarchy_power_sum_radius", with_sql(FOREST_SQL, KIDS_SQL, CLOSURE_SQL, recursive=True, body=f"""
SELECT u.tree, u.id, {sig_sql(f'pow(sum(pow(l.radius_mm, {GAMMA})), {1 / GAMMA})', 11)} AS radius_mm
FROM up u JOIN top l ON l.tree = u.tree AND l.id = u.leaf WHERE l.n_children = 0 GROUP BY 1, 2"""))
def power_radius(spark, sf):
    return trees.power_radii(forest(spark, sf), GAMMA).select("tree", "id", sig(F.col("radius_mm"), 11).alias("radius_mm"))


@register("hierarchy_subtree_sum", with_sql(FOREST_SQL, CLOSURE_SQL, recursive=True, body=f"""
SELECT u.tree, u.id, CAST(count(*) AS BIGINT) AS n_below, {sig_sql('sum(l.length_mm)', 8)} AS length_below
FROM up u JOIN seg l ON l.tree = u.tree AND l.id = u.leaf GROUP BY 1, 2"""))
def subtree_sum(spark, sf):
    out = trees.subtree_sums(forest(spark, sf), {"n": F.lit(1.0), "l": F.col("length_mm")})
    return out.select("tree", "id", F.round("n").cast("bigint").alias("n_below"), sig(F.col("l"), 8).alias("length_below"))


RES = f"8*{flow.VISCOSITY}*(length_mm*1e-3)/(pi()*pow(radius_mm*1e-3,4.0))"
FLOW_SQL = [FOREST_SQL, DEPTH_SQL, LEVEL_UP, f"""
tube AS (SELECT *, {RES} AS r FROM node),
rise AS (SELECT tree, id, parent_id, depth, r, r AS rs FROM tube, dmax WHERE depth = d
  UNION ALL
  SELECT n.tree, n.id, n.parent_id, n.depth, n.r, n.r + coalesce(1 / k.g, 0)
  FROM (SELECT DISTINCT depth AS lv FROM rise) l JOIN tube n ON n.depth = l.lv - 1
  LEFT JOIN (SELECT tree, parent_id, sum(1 / rs) AS g FROM rise GROUP BY 1, 2) k
  ON k.tree = n.tree AND k.parent_id = n.id)""", f"""
shr AS (SELECT *, CASE WHEN parent_id < 0 THEN ({flow.ROOT_PA} - {flow.TERMINAL_PA}) / rs
        ELSE (1 / rs) / sum(1 / rs) OVER (PARTITION BY tree, parent_id) END AS share FROM rise),
flw AS (SELECT tree, id, r, rs, share AS q, CAST({flow.ROOT_PA} AS DOUBLE) AS pp, CAST({flow.ROOT_PA} AS DOUBLE) - share * r AS pd FROM shr WHERE parent_id < 0
  UNION ALL SELECT s.tree, s.id, s.r, s.rs, f.q * s.share, f.pd, f.pd - f.q * s.share * s.r
  FROM flw f JOIN shr s ON s.tree = f.tree AND s.parent_id = f.id)"""]


def flowing(spark, sf):
    segs = forest(spark, sf).withColumn("resistance", flow.resistance(F.col("length_mm"), F.col("radius_mm")))
    return trees.flows_and_pressures(segs, F.lit(flow.ROOT_PA), F.lit(flow.TERMINAL_PA))


@register("hierarchy_series_parallel_resistance", with_sql(*FLOW_SQL[:4], recursive=True,
          body=f"SELECT tree, id, {sig_sql('rs', 8)} AS r_sub FROM rise"))
def series_parallel(spark, sf):
    segs = forest(spark, sf).withColumn("resistance", flow.resistance(F.col("length_mm"), F.col("radius_mm")))
    return trees.subtree_resistance(segs).select("tree", "id", sig(F.col("r_sub"), 8).alias("r_sub"))


@register("hierarchy_flow_split_and_pressure", with_sql(*FLOW_SQL, recursive=True, body=f"""
SELECT tree, id, {sig_sql('q', 7)} AS flow, round(pp, 3) AS p_prox, round(pd, 3) AS p_dist FROM flw"""))
def flow_pressure(spark, sf):
    return flowing(spark, sf).select(
        "tree", "id", sig(F.col("flow_m3_s"), 7).alias("flow"),
        F.round("p_prox_pa", 3).alias("p_prox"), F.round("p_dist_pa", 3).alias("p_dist"),
    )
