"""Registered queries: scalar expressions and filters."""

from pyspark.sql import functions as F

from arborlake.catalog.bed import FOREST_SQL, LINES_SQL, POINTS_SQL, TWIGS_SQL, forest, lines, points, sig, sig_sql, table, twigs, with_sql
from arborlake.catalog.q_stats import ORD_SQL, PRM, ranked
from arborlake.catalog.q_trees import CLOSURE_SQL, FLOW_SQL, KIDS_SQL, flowing
from arborlake.functions import domains, flow, geometry as g, morphometry, text
from arborlake.functions.vectors import triple
from arborlake.operators import filters, stats, trees
from arborlake.operators.spatial import end, place, start

QUERIES, ORACLE = {}, {}
GAMMA = flow.GAMMA


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@register("segment_length_and_midpoint", with_sql(FOREST_SQL, body="""
SELECT tree, id, round(length_mm, 6) AS length_mm, round((px+dx)/2, 6) AS mx, round((py+dy)/2, 6) AS my, round((pz+dz)/2, 6) AS mz FROM seg"""))
def length_midpoint(spark, sf):
    segs = forest(spark, sf)
    m = g.midpoint(start(), end())
    return segs.select("tree", "id", F.round(g.segment_length(start(), end()), 6).alias("length_mm"), *[F.round(v, 6).alias(f"m{a}") for v, a in zip(m, "xyz")])


@register("tube_formulas", with_sql(FOREST_SQL, f"""
f AS (SELECT tree, id, length_mm AS l, radius_mm AS r, greatest(radius_mm*2000, 2.0) AS d FROM seg),
v AS (SELECT *, 1/(1+1e-11*pow(d,12.0)) AS sat FROM f),
w AS (SELECT *, (0.8+exp(-0.075*d))*(sat-1)+sat AS c, pow(d/(d-1.1), 2.0) AS lay, 6.0*exp(-0.085*d)+3.2-2.44*exp(-0.06*pow(d,0.645)) AS m FROM v),
u AS (SELECT *, (1+(m-1)*((pow(0.55,c)-1)/(pow(0.55,c)-1))*lay)*lay*0.0012 AS mu FROM w)""", body=f"""
SELECT tree, id, {sig_sql('2*r')} AS diameter_mm, {sig_sql('CASE WHEN r > 0 THEN l/(2*r) ELSE 0 END')} AS length_per_diameter,
 {sig_sql(f'8*{flow.VISCOSITY}*l*1e-3/(pi()*pow(r*1e-3,4.0))', 8)} AS resistance, {sig_sql('mu', 8)} AS viscosity,
 {sig_sql('greatest(128*mu*(CASE WHEN l <= 0 THEN 1e-9 ELSE l*1e-3 END)/(pi()*pow(r*2000*1e-6,4.0)), 1e-20)', 8)} AS resistance_small,
 {sig_sql('pi()*r*r*l/1000')} AS volume_ml FROM u"""))
def tube(spark, sf):
    r, l = F.col("radius_mm"), F.col("length_mm")
    return forest(spark, sf).select(
        "tree", "id", sig(2 * r).alias("diameter_mm"), sig(F.when(r > 0, l / (2 * r)).otherwise(F.lit(0.0))).alias("length_per_diameter"),
        sig(flow.resistance(l, r), 8).alias("resistance"), sig(flow.pries_viscosity(r * 2000), 8).alias("viscosity"),
        sig(flow.resistance_by_diameter(l, r * 2000), 8).alias("resistance_small"), sig(flow.volume_ml(l, r)).alias("volume_ml"))


# Flow in proportion to r^gamma of the leaves below, so that every segment carries some at any depth.
@register("transit_time", with_sql(FOREST_SQL, KIDS_SQL, CLOSURE_SQL, f"""
fq AS (SELECT u.tree, u.id, 1e-9 * sum(pow(l.radius_mm, {GAMMA!r})) AS q FROM up u JOIN top l ON l.tree = u.tree AND l.id = u.leaf AND l.n_children = 0 GROUP BY 1, 2),
tt AS (SELECT f.tree, f.id, greatest(pi()*s.radius_mm*s.radius_mm*s.length_mm/1000*1e-6/abs(f.q), 1e-9) AS tau FROM fq f JOIN seg s ON s.tree=f.tree AND s.id=f.id)""",
 recursive=True, body=f"SELECT tree, id, {sig_sql('tau', 7)} AS transit_s FROM tt"))
def transit(spark, sf):
    segs = trees.with_children(forest(spark, sf))
    own = F.when(F.col("is_terminal"), 1e-9 * F.pow("radius_mm", GAMMA)).otherwise(F.lit(0.0))
    tau = flow.transit_time_s(flow.volume_ml(F.col("length_mm"), F.col("radius_mm")), F.col("q"), F.col("id"))
    return segs.join(trees.subtree_sums(segs, {"q": own}), ["tree", "id"]).select("tree", "id", sig(tau, 7).alias("transit_s"))


@register("flow_per_tree_base_and_dilated", with_sql(FOREST_SQL, """
cases AS (SELECT 'base' AS c UNION ALL SELECT 'dilated'),
dil AS (SELECT c.c || ':' || tree AS tree, id, parent_id, length_mm, CASE WHEN c.c = 'dilated' AND radius_mm*2000 BETWEEN 0 AND 40 THEN radius_mm*1.6 ELSE radius_mm END AS r FROM seg, cases c),
dep AS (SELECT tree, id, parent_id, 0 AS depth FROM dil WHERE parent_id < 0 UNION ALL
  SELECT s.tree, s.id, s.parent_id, d.depth + 1 FROM dep d JOIN dil s ON s.tree = d.tree AND s.parent_id = d.id),
dmax AS (SELECT max(depth) AS d FROM dep)""", f"""
tube AS (SELECT s.tree, s.id, s.parent_id, d.depth, 8*{flow.VISCOSITY}*(s.length_mm*1e-3)/(pi()*pow(s.r*1e-3,4.0)) AS r FROM dil s JOIN dep d ON d.tree = s.tree AND d.id = s.id),
rise AS (SELECT tree, id, parent_id, depth, r AS rs FROM tube, dmax WHERE depth = d UNION ALL
  SELECT n.tree, n.id, n.parent_id, n.depth, n.r + coalesce(1 / k.g, 0) FROM (SELECT DISTINCT depth AS lv FROM rise) l JOIN tube n ON n.depth = l.lv - 1
  LEFT JOIN (SELECT tree, parent_id, sum(1 / rs) AS g FROM rise GROUP BY 1, 2) k ON k.tree = n.tree AND k.parent_id = n.id)""", recursive=True, body=f"""
SELECT split_part(tree, ':', 1) AS "case", split_part(tree, ':', 2) AS tree, {sig_sql(f'({flow.ROOT_PA}-{flow.TERMINAL_PA})/rs*6e7', 7)} AS flow_ml_min FROM rise WHERE id = 1"""))
def tree_flow(spark, sf):
    segs = forest(spark, sf)
    cases = segs.withColumn("case", F.lit("base")).unionByName(segs.withColumns({
        "case": F.lit("dilated"), "radius_mm": flow.in_band_scaled(F.col("radius_mm"), F.col("radius_mm") * 2000, 1.6, 0.0, 40.0)}))
    both = cases.withColumn("tree", F.concat_ws(":", "case", "tree")).withColumn("resistance", flow.resistance(F.col("length_mm"), F.col("radius_mm")))
    root = trees.subtree_resistance(both).where("id = 1")
    q = (flow.ROOT_PA - flow.TERMINAL_PA) / F.col("r_sub") * flow.ML_PER_MIN
    return root.select(F.split_part("tree", F.lit(":"), F.lit(1)).alias("case"), F.split_part("tree", F.lit(":"), F.lit(2)).alias("tree"),
                       sig(q, 7).alias("flow_ml_min"))


TARGETS = {"LAD": 242.0, "LCX": 116.0, "RCA": 214.0}  # fixed values, mL/min


@register("flow_calibration_score", ORACLE["flow_per_tree_base_and_dilated"].replace(
    'SELECT split_part(tree', 'SELECT "case", ' + sig_sql("sum(abs(flow_ml_min - CASE tree WHEN 'LAD' THEN 242 WHEN 'LCX' THEN 116 ELSE 214 END))", 6)
    + ' AS score FROM (SELECT split_part(tree', 1) + ') GROUP BY 1')
def calibration(spark, sf):
    flows = tree_flow(spark, sf).withColumnRenamed("flow_ml_min", "flow")
    goals = spark.createDataFrame([(c, t, v) for c in ("base", "dilated") for t, v in TARGETS.items()], "case string, tree string, target double")
    return stats.calibration_score(flows, goals).select("case", sig(F.col("score"), 6).alias("score"))


ANG = f"""pr AS (SELECT s.tree, s.parent_id AS id, min(radius_mm) AS lo, max(radius_mm) AS hi, min(length_mm) AS dist FROM seg s WHERE parent_id > 0
  GROUP BY 1, 2 HAVING count(*) = 2),
rh AS (SELECT pr.*, p.radius_mm AS pr, CASE WHEN hi <= 0 THEN 0 ELSE lo/hi END AS rho FROM pr JOIN seg p ON p.tree = pr.tree AND p.id = pr.id),
rr AS (SELECT *, CASE WHEN rho < 0.83 THEN 1.0 ELSE pow(1+pow(rho,{GAMMA!r}),{1 / GAMMA!r}) END AS rp FROM rh),
cs AS (SELECT *, least(greatest((pow(rp,4)+1-pow(rho,4))/(2*rp*rp),-1.0),1.0) AS cl,
  CASE WHEN 2*rp*rp*rho*rho > 1e-30 THEN least(greatest((pow(rp,4)+pow(rho,4)-1)/(2*rp*rp*rho*rho),-1.0),1.0) ELSE 0.0 END AS co FROM rr)"""


@register("junction_kind_and_angles", with_sql(FOREST_SQL, ANG, body=f"""
SELECT tree, id, {sig_sql('CASE WHEN dist <= 0 THEN 1e300 ELSE 2*pi()*pr/dist END')} AS chi, {sig_sql('rho')} AS rho,
 CASE WHEN rho < 0.83 THEN 'sprouting' ELSE 'branching' END AS kind,
 round(least(least(acos(cl), 1.31), CASE WHEN rho < 0.83 THEN 0.1 ELSE 9 END), 6) AS angle_large, round(least(acos(co), 1.31), 6) AS angle_small FROM cs"""))
def junction_angles(spark, sf):
    edges = trees.parent_child(forest(spark, sf), ["radius_mm"], ["radius_mm", "length_mm"])
    pair = edges.groupBy("tree", F.col("parent_id").alias("id")).agg(
        F.min("c_radius_mm").alias("lo"), F.max("c_radius_mm").alias("hi"), F.min("c_length_mm").alias("dist"),
        F.first("p_radius_mm").alias("pr"), F.count("*").alias("n")).where("n = 2")
    rho = F.col("rho")
    pair = pair.withColumn("rho", g.radius_ratio(F.col("lo"), F.col("hi")))
    large, small = g.junction_angles(rho, GAMMA)
    return pair.select("tree", "id", sig(g.closeness(F.col("pr"), F.col("dist"))).alias("chi"), sig(rho).alias("rho"),
                       g.junction_kind(rho).alias("kind"), F.round(large, 6).alias("angle_large"), F.round(small, 6).alias("angle_small"))


@register("three_way_angles", with_sql(FOREST_SQL, """
tri AS (SELECT tree, parent_id, id, radius_mm, count(*) OVER (PARTITION BY tree, parent_id) AS n, sum(1/(radius_mm+1e-20)) OVER (PARTITION BY tree, parent_id) AS w FROM seg WHERE parent_id > 0)""",
 body="SELECT tree, id, round(2.1 * (1/(radius_mm+1e-20)) / w, 7) AS angle FROM tri WHERE n = 3"))
def three_way(spark, sf):
    kids = forest(spark, sf).where("parent_id > 0").groupBy("tree", "parent_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "radius_mm"))).alias("k")).where(F.size("k") == 3)
    angles = g.three_way_angles([F.col("k")[i]["radius_mm"] for i in range(3)])
    return kids.select("tree", F.inline(F.array(*[F.struct(F.col("k")[i]["id"].alias("id"), F.round(a, 7).alias("angle")) for i, a in enumerate(angles)])))


@register("daughter_radii", with_sql(FOREST_SQL, f"""
dr AS (SELECT tree, id, radius_mm AS r, (id % 9 + 1) / 10.0 AS a FROM seg),
dd AS (SELECT *, r/pow(1+pow(a,{GAMMA!r}),{1 / GAMMA!r}) AS lg, pow(r,{GAMMA!r})-pow(a*r,{GAMMA!r}) AS rem FROM dr)""", body=f"""
SELECT tree, id, {sig_sql('lg')} AS large, {sig_sql('a*lg')} AS small, {sig_sql(f'r/pow(2.0,{1 / GAMMA!r})')} AS equal_split,
 CASE WHEN rem > 0 AND pow(rem,{1 / GAMMA!r}) > a*r THEN {sig_sql(f'pow(rem,{1 / GAMMA!r})')} END AS remainder FROM dd"""))
def radii(spark, sf):
    r, a = F.col("radius_mm"), (F.col("id") % 9 + 1) / 10.0
    large, small = g.split_radii(r, a, GAMMA)
    equal, _ = g.split_radii(r, 1.0, GAMMA)
    rest = g.remainder_radius(r, a * r, GAMMA)
    return forest(spark, sf).select("tree", "id", sig(large).alias("large"), sig(small).alias("small"), sig(equal).alias("equal_split"),
                                    F.when(rest.isNotNull(), sig(rest)).alias("remainder"))


@register("prefix_scale_and_blend", with_sql(FOREST_SQL, """
tg AS (SELECT s.tree, s.id, s.radius_mm * (3.0 / 2000 / (r.radius_mm)) * 1000 AS target FROM seg s JOIN seg r ON r.tree = s.tree AND r.id = 1 WHERE s.id <= 40)""", body=f"""
SELECT s.tree, s.id, {sig_sql('CASE WHEN t.target IS NULL THEN s.radius_mm ELSE 0.7*s.radius_mm + 0.3*t.target END')} AS radius_mm FROM seg s LEFT JOIN tg t ON t.tree = s.tree AND t.id = s.id"""))
def blend(spark, sf):
    from arborlake.operators.growth import blend_prefix, scaled_prefix

    segs = forest(spark, sf)
    targets = scaled_prefix(segs, 40, F.lit(3000.0))
    return blend_prefix(segs, targets, 0.3).select("tree", "id", sig(F.col("radius_mm")).alias("radius_mm"))


SHAPES = {
    "sphere": domains.Sphere((50.0, 50.0, 50.0), 30.0), "box": domains.Box((20.0, 25.0, 30.0), (70.0, 80.0, 75.0)),
    "ellipsoid": domains.Ellipsoid((50.0, 50.0, 50.0), (40.0, 30.0, 20.0)),
    "shell": domains.EllipsoidShell((50.0, 50.0, 50.0), (45.0, 40.0, 35.0), 0.3),
}
EL = "sqrt(pow((x-50)/40,2)+pow((y-50)/30,2)+pow((z-50)/20,2))"
SH = "sqrt(pow((x-50)/45,2)+pow((y-50)/40,2)+pow((z-50)/35,2))"
SP = "sqrt(pow(x-50,2)+pow(y-50,2)+pow(z-50,2))"
BOUT = "sqrt(pow(greatest(20-x,x-70,0.0),2)+pow(greatest(25-y,y-80,0.0),2)+pow(greatest(30-z,z-75,0.0),2))"
BIN = "least(x-20,70-x,y-25,80-y,z-30,75-z)"


def _shape_sql(name, sd, proj):
    return f"SELECT '{name}' AS shape, qid, {sd} <= 0 AS inside, round({sd}, 6) AS signed_distance, " + ", ".join(
        f"round({p}, 6) AS {a}" for p, a in zip(proj, "xyz")) + " FROM pt"


def _toward(center, r, limit):
    return [f"CASE WHEN {r} <= {limit} THEN {a} ELSE {c}+({a}-{c})*{limit}/{r} END" for a, c in zip("xyz", center)]


@register("domain_inside_distance_projection", with_sql(POINTS_SQL, body=" UNION ALL ".join([
    _shape_sql("sphere", f"({SP}-30)", _toward((50, 50, 50), SP, "30.0")),
    _shape_sql("box", f"(CASE WHEN {BOUT} > 0 THEN {BOUT} ELSE -{BIN} END)", ["least(greatest(x,20.0),70.0)", "least(greatest(y,25.0),80.0)", "least(greatest(z,30.0),75.0)"]),
    _shape_sql("ellipsoid", f"(({EL}-1)*20)", _toward((50, 50, 50), EL, "1.0")),
    _shape_sql("shell", f"(CASE WHEN {SH} > 1 THEN ({SH}-1)*35 WHEN {SH} < 0.7 THEN (0.7-{SH})*35 ELSE -least((1-{SH})*35,({SH}-0.7)*35) END)",
               [f"CASE WHEN {SH} < 1e-15 THEN {c} WHEN {SH} > 1 THEN 50+({a}-50)/{SH} WHEN {SH} < 0.7 THEN 50+({a}-50)*0.7/{SH} ELSE {a} END"
                for a, c in zip("xyz", (50 + 0.85 * 45, 50, 50))])])))
def domain_tests(spark, sf):
    pts, out = points(spark, sf), None
    for name, dom in SHAPES.items():
        x, y, z = dom.project(place())
        part = pts.select(F.lit(name).alias("shape"), "qid", dom.inside(place()).alias("inside"), F.round(dom.signed_distance(place()), 6).alias("signed_distance"),
                          F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))
        out = part if out is None else out.unionByName(part)
    return out


@register("segment_leaves_domain", with_sql(FOREST_SQL, body="""
SELECT tree, id, list_bool_or([pow(px+i/11.0*(dx-px)-50,2)+pow(py+i/11.0*(dy-py)-50,2)+pow(pz+i/11.0*(dz-pz)-50,2) > 30.0*30.0 FOR i IN range(1, 11)]) AS crossing FROM seg"""))
def crossing(spark, sf):
    return forest(spark, sf).select("tree", "id", SHAPES["sphere"].crossed_by(start(), end()).alias("crossing"))


@register("nearest_bin_index", with_sql(FOREST_SQL, "bn AS (SELECT unnest([0.0, 10.0, 20.0, 40.0, 80.0, 160.0]) AS b, unnest(range(1, 7)) AS i)", body="""
SELECT tree, id, CAST(arg_min(i, (abs(radius_mm*2000 - b), i)) AS INTEGER) AS bin FROM seg, bn GROUP BY 1, 2"""))
def nearest_bin(spark, sf):
    return forest(spark, sf).select("tree", "id", flow.nearest_bin(F.col("radius_mm") * 2000, [0.0, 10.0, 20.0, 40.0, 80.0, 160.0]).alias("bin"))


@register("parameter_lookup_per_tree", with_sql(FOREST_SQL, body="""
SELECT tree, count(*) AS n, CASE tree WHEN 'LAD' THEN 12 WHEN 'RCA' THEN 12 ELSE 11 END::INTEGER AS n_orders, CASE tree WHEN 'LCX' THEN 'RCA' ELSE tree END AS artery_override,
 CAST(2000.0 AS DOUBLE) AS terminal_pa, CAST(13332.0 AS DOUBLE) AS root_pa FROM seg GROUP BY 1"""))
def params_lookup(spark, sf):
    rows = stats.with_artery(forest(spark, sf)).groupBy("tree", "artery").agg(F.count("*").alias("n"))
    params = morphometry.with_values(morphometry.scalars(spark), terminal_pa=2000.0)
    picked = rows.join(F.broadcast(params), "artery")
    return picked.select("tree", "n", "n_orders", morphometry.artery_of(F.col("tree"), override={"LCX": "RCA"}).alias("artery_override"), "terminal_pa", "root_pa")


@register("cutoff_filters", with_sql(FOREST_SQL, body="""
SELECT tree, count(*) FILTER (radius_mm*1000 >= 20) AS by_radius, count(*) FILTER (radius_mm*2000 >= 20) AS by_diameter FROM seg GROUP BY 1"""))
def cutoffs(spark, sf):
    segs = forest(spark, sf)
    a = filters.radius_at_least(segs, 20.0).groupBy("tree").agg(F.count("*").alias("by_radius"))
    b = filters.diameter_at_least(segs, 20.0).groupBy("tree").agg(F.count("*").alias("by_diameter"))
    return a.join(b, "tree")


@register("select_by_name_and_pattern", """SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|widget') AND p_name IN
 (SELECT p_name FROM part WHERE p_size < 20)""")
def by_name(spark, sf):
    part = table(spark, sf, "part")
    names = part.where("p_size < 20").select(F.col("p_name").alias("name"))
    return filters.select_named(part, "p_name", "ring|widget", names).select("p_partkey", "p_name")


@register("names_missing", "SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3)")
def names_missing(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_name").alias("name"), "p_size")
    return filters.missing_names(part, part.where("p_size < 3"))


@register("split_point_validity", with_sql(TWIGS_SQL, """
sp AS (SELECT *, (id % 20) / 20.0 AS t FROM twig),
sq AS (SELECT *, sqrt(pow(50-(px+t*(dx-px)),2)+pow(50-(py+t*(dy-py)),2)+pow(50-(pz+t*(dz-pz)),2)) AS nl FROM sp)""", body="""
SELECT tree, id, t > 0.05 AND t < 0.95 AND length_mm >= greatest(0.2, 0.5*radius_mm) AND t*length_mm >= 0.05 AND (1-t)*length_mm >= 0.05 AND nl >= 0.05 AS valid FROM sq"""))
def split_validity(spark, sf):
    t = (F.col("id") % 20) / 20.0
    at = tuple(p + t * (d - p) for p, d in zip(start(), end()))
    new = g.segment_length(at, tuple(F.lit(50.0) for _ in "xyz"))
    return twigs(spark, sf).select("tree", "id", g.split_point_valid(t, F.col("length_mm"), F.col("radius_mm"), new).alias("valid"))


@register("length_gate_by_order", with_sql(FOREST_SQL, PRM, ORD_SQL, """
lg AS (SELECT r.tree, r.id, r.length_mm, greatest(p.l_mean + 2.5*p.l_sd, p.l_mean*1.5, 32.0)/1000 AS lim FROM ranked r JOIN prm p ON p.artery = r.tree AND p.ord = greatest(r.o, 3))""",
 body="SELECT tree, id, round(lim, 9) AS limit_mm, length_mm <= lim AS fits FROM lg"))
def gate(spark, sf):
    params = morphometry.order_params(spark)
    segs = stats.class_order(forest(spark, sf), params)
    return filters.length_gate(segs, params, handoff_order=3).select("tree", "id", F.round("limit_mm", 9).alias("limit_mm"), "fits")


@register("prune_oversized_leaves", with_sql(FOREST_SQL, KIDS_SQL, body="SELECT tree, id FROM top WHERE parent_id < 0 OR NOT (n_children = 0 AND radius_mm*2000 > 50)"))
def prune(spark, sf):
    return filters.prune_leaves(forest(spark, sf)).select("tree", "id")


@register("flow_invariants", with_sql(*FLOW_SQL, """
bad AS (SELECT f.tree, f.id, f.pp, f.pd, f.q * (CASE WHEN f.id % 50 = 0 THEN -1 WHEN f.id % 33 = 0 THEN 2 ELSE 1 END) AS q, s.parent_id FROM flw f JOIN seg s ON s.tree = f.tree AND s.id = f.id),
ks AS (SELECT c.tree, c.parent_id AS id, sum(c.q) AS s, any_value(p.q) AS q FROM bad c JOIN bad p ON p.tree = c.tree AND p.id = c.parent_id GROUP BY 1, 2 HAVING count(*) >= 2)""", recursive=True, body="""
SELECT tree, id, 'flow not positive' AS rule FROM bad WHERE q <= 0 UNION ALL SELECT tree, id, 'pressure rises' FROM bad WHERE pp < pd - 1e-6
UNION ALL SELECT tree, id, 'flow not kept' FROM ks WHERE abs(q - s) > 1e-4 * greatest(abs(q), abs(s))"""))
def invariants(spark, sf):
    q = F.col("flow_m3_s") * F.when(F.col("id") % 50 == 0, -1).when(F.col("id") % 33 == 0, 2).otherwise(1)
    return filters.flow_violations(flowing(spark, sf).withColumn("flow_m3_s", q))


@register("line_end_caps", with_sql(LINES_SQL, """
lm AS (SELECT line, 0.6*median(radius_mm) AS m FROM ln WHERE radius_mm > 0 GROUP BY 1),
lf AS (SELECT l.line, min(pos) FILTER (radius_mm >= m) AS a, max(pos) FILTER (radius_mm >= m) AS b FROM ln l JOIN lm ON lm.line = l.line GROUP BY 1)""",
 body="SELECT l.line, l.pos FROM ln l LEFT JOIN lf ON lf.line = l.line WHERE a IS NULL OR pos BETWEEN a AND b"))
def end_caps(spark, sf):
    return filters.trim_end_caps(lines(spark, sf), 0.6).select("line", F.col("pos").cast("bigint").alias("pos"))


@register("line_root_cap", with_sql(LINES_SQL, """
lw AS (SELECT line, count(*) AS n, max(radius_mm) * 0.75 AS m FROM ln GROUP BY 1),
lk AS (SELECT l.line, min(pos) FILTER (n > 4 AND radius_mm >= m AND pos <= greatest(1, least(n - 3, CAST(floor(n*0.25) AS BIGINT) + 1))) AS k FROM ln l JOIN lw ON lw.line = l.line GROUP BY 1)""",
 body="SELECT l.line, l.pos FROM ln l JOIN lk ON lk.line = l.line WHERE pos >= coalesce(k, 1)"))
def root_cap(spark, sf):
    return filters.trim_root_cap(lines(spark, sf)).select("line", F.col("pos").cast("bigint").alias("pos"))


@register("dynamic_label_filter", "SELECT DISTINCT p_size AS label FROM part WHERE contains(lower(p_name || CASE p_size % 7 WHEN 0 THEN '_Blood' ELSE '' END), '_blood') OR contains(lower(p_name), 'iodine') ORDER BY 1")
def dynamic(spark, sf):
    part = table(spark, sf, "part")
    name = F.concat("p_name", F.when(F.col("p_size") % 7 == 0, "_Blood").otherwise(""))
    return filters.dynamic_labels(part.select(F.col("p_size").alias("label"), name.alias("name")))


@register("text_and_time_forms", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%S') AS stamp, strftime(o_orderdate + to_seconds(CAST(o_orderkey % 5000 AS BIGINT)), '%H%M%S') AS clock,
 replace(o_orderpriority || ',x', ',', '_') AS plain, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS padded,
 rtrim(rtrim(printf('%.4f', o_totalprice / 3), '0'), '.') AS short FROM orders""")
def text_forms(spark, sf):
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", text.run_stamp(day).alias("stamp"), text.clock_after(day, (F.col("o_orderkey") % 5000).cast("decimal(18,6)")).alias("clock"),
                    text.plain_name(F.concat("o_orderpriority", F.lit(",x"))).alias("plain"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("padded"),
                    text.short_number(F.col("o_totalprice") / 3, 4).alias("short"))
