"""Registered queries: radius and geometry passes, territories, draws and expansion."""

from pyspark.sql import functions as F

from arborlake.catalog.bed import FOREST_SQL, POINTS_SQL, TWIGS_SQL, forest, points, sig, sig_sql, table, twigs, with_sql
from arborlake.catalog.q_stats import ORD_SQL, PRM, RATE, ranked
from arborlake.catalog.q_trees import CLOSURE_SQL, DEPTH_SQL, KIDS_SQL
from arborlake.functions import domains, draws, flow, geometry as g, morphometry
from arborlake.functions.vectors import triple
from arborlake.operators import growth, stats, synth, territory, trees

QUERIES, ORACLE = {}, {}
GAMMA = flow.GAMMA
BALL = domains.Sphere((50.0, 50.0, 50.0), 55.0)


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@register("diameter_defined_order")
def diameter_order(spark, sf):
    return trees.diameter_order(forest(spark, sf)).select("tree", "id", "strahler_order", "rounds")


@register("terminal_flows_and_radii")
def terminal_flows(spark, sf):
    segs = twigs(spark, sf).withColumn("resistance", flow.resistance(F.greatest("length_mm", F.lit(0.01)), F.col("radius_mm")))
    q = growth.terminal_flows(segs, flow.ROOT_PA, flow.TERMINAL_PA)
    radii = growth.radii_from_flow(segs.join(q, ["tree", "id"]), GAMMA)
    return q.join(radii, ["tree", "id"]).select("tree", "id", sig(F.col("flow_m3_s"), 7).alias("flow"), sig(F.col("radius_mm"), 7).alias("radius"))


@register("redrawn_radii")
def redrawn(spark, sf):
    return growth.redrawn_radii(forest(spark, sf), GAMMA, seed=7).select("tree", "id", sig(F.col("radius_mm"), 7).alias("radius_mm"))


@register("repair_invalid_order_pairs", with_sql(FOREST_SQL, KIDS_SQL, PRM, RATE, ORD_SQL, CLOSURE_SQL, f"""
nk AS (SELECT tree, parent_id, count(*) AS n FROM seg WHERE parent_id > 0 GROUP BY 1, 2),
eg AS (SELECT c.tree, c.id, c.o AS co, p.o AS po FROM ranked c JOIN ranked p ON p.tree = c.tree AND p.id = c.parent_id JOIN nk ON nk.tree = p.tree AND nk.parent_id = p.id AND nk.n = 2 WHERE p.o >= 1),
mv AS (SELECT e.tree, e.id, arg_min(r.child_order, (abs(r.child_order - e.co), r.child_order)) AS o FROM eg e JOIN rate r ON r.artery = e.tree AND r.parent_order = e.po
  WHERE NOT EXISTS (SELECT 1 FROM rate v WHERE v.artery = e.tree AND v.parent_order = e.po AND v.child_order = e.co) GROUP BY 1, 2),
ch AS (SELECT t.tree, t.id, t.n_children, coalesce(p.d_mean / 2000, t.radius_mm) AS r FROM top t LEFT JOIN mv m ON m.tree = t.tree AND m.id = t.id LEFT JOIN prm p ON p.artery = m.tree AND p.ord = m.o)""", recursive=True, body=f"""
SELECT u.tree, u.id, {sig_sql(f'pow(sum(pow(l.r, {GAMMA!r})), {1 / GAMMA!r})', 10)} AS radius_mm FROM up u JOIN ch l ON l.tree = u.tree AND l.id = u.leaf AND l.n_children = 0
WHERE u.tree IN (SELECT tree FROM mv) GROUP BY 1, 2 UNION ALL SELECT tree, id, {sig_sql('r', 10)} FROM ch WHERE tree NOT IN (SELECT tree FROM mv)"""))
def repair(spark, sf):
    segs = stats.class_order(forest(spark, sf), morphometry.order_params(spark))
    out = growth.valid_child_radii(segs, morphometry.order_params(spark), morphometry.connectivity(spark), GAMMA)
    return out.select("tree", "id", sig(F.col("radius_mm"), 10).alias("radius_mm"))


@register("hop_neighbourhood_size", with_sql(FOREST_SQL, """
mv AS (SELECT tree, id AS a, parent_id AS b FROM seg WHERE parent_id > 0 UNION ALL SELECT tree, parent_id, id FROM seg WHERE parent_id > 0),
wk AS (SELECT tree, id AS start, id AS at, CAST(-1 AS BIGINT) AS came, 0 AS h FROM seg UNION ALL
  SELECT w.tree, w.start, m.b, w.at, w.h + 1 FROM wk w JOIN mv m ON m.tree = w.tree AND m.a = w.at WHERE w.h < 8 AND m.b <> w.came)""", recursive=True, body="""
SELECT tree, start, count(*) AS n, max(h) AS farthest FROM wk GROUP BY 1, 2"""))
def hops(spark, sf):
    near = trees.neighbourhood(forest(spark, sf), 8)
    return near.groupBy("tree", "start").agg(F.count("*").alias("n"), F.max("hops").alias("farthest"))


#: Bends and turns of daughters (the two-way form as in the angles of a junction), then every row from its parent's end.
TURNS = f"""sib AS (SELECT tree, id, parent_id, px, py, pz, dx - px AS vx, dy - py AS vy, dz - pz AS vz, row_number() OVER w AS slot, count(*) OVER q AS n,
  first_value(radius_mm) OVER q2 AS r1, nth_value(radius_mm, 2) OVER q2 AS r2, nth_value(radius_mm, 3) OVER q2 AS r3 FROM seg
  WINDOW w AS (PARTITION BY tree, parent_id ORDER BY id), q AS (PARTITION BY tree, parent_id), q2 AS (PARTITION BY tree, parent_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
rat AS (SELECT *, CASE WHEN greatest(r1, r2) <= 0 THEN 0 ELSE least(r1, r2) / greatest(r1, r2) END AS rho, CASE WHEN slot = 1 THEN r1 >= r2 ELSE r1 < r2 END AS large FROM sib),
par AS (SELECT *, CASE WHEN rho < 0.83 THEN 1.0 ELSE pow(1 + pow(rho, {GAMMA!r}), {1 / GAMMA!r}) END AS rp FROM rat),
ben AS (SELECT *, least(least(acos(least(greatest((pow(rp,4)+1-pow(rho,4))/(2*rp*rp),-1.0),1.0)), 1.31), CASE WHEN rho < 0.83 THEN 0.1 ELSE 9 END) AS big,
  least(acos(CASE WHEN 2*rp*rp*rho*rho > 1e-30 THEN least(greatest((pow(rp,4)+pow(rho,4)-1)/(2*rp*rp*rho*rho),-1.0),1.0) ELSE 0.0 END), 1.31) AS little FROM par),
trn AS (SELECT *, CASE n WHEN 2 THEN CASE WHEN large THEN big ELSE little END
    WHEN 3 THEN {g.THREE_WAY_BUDGET!r} * (1 / (CASE slot WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END + 1e-20)) / (1 / (r1 + 1e-20) + 1 / (r2 + 1e-20) + 1 / (r3 + 1e-20)) END AS bend,
  CASE n WHEN 2 THEN CASE WHEN large THEN 0.0 ELSE pi() END ELSE (slot - 1) * 2 * pi() / 3 END AS turn FROM ben),
plc AS (SELECT tree, id, px AS sx, py AS sy, pz AS sz, px + vx AS ex, py + vy AS ey, pz + vz AS ez FROM trn WHERE parent_id = -1
  UNION ALL SELECT tree, id, sx, sy, sz,
    CASE WHEN still THEN sx + vx ELSE sx + len * (ux * cos(bend) + (qx * cos(turn) + (uy*qz - uz*qy) * sin(turn)) * sin(bend)) END,
    CASE WHEN still THEN sy + vy ELSE sy + len * (uy * cos(bend) + (qy * cos(turn) + (uz*qx - ux*qz) * sin(turn)) * sin(bend)) END,
    CASE WHEN still THEN sz + vz ELSE sz + len * (uz * cos(bend) + (qz * cos(turn) + (ux*qy - uy*qx) * sin(turn)) * sin(bend)) END
  FROM (SELECT *, cx / sqrt(cx*cx+cy*cy+cz*cz) AS qx, cy / sqrt(cx*cx+cy*cy+cz*cz) AS qy, cz / sqrt(cx*cx+cy*cy+cz*cz) AS qz
  FROM (SELECT *, CASE weak WHEN 'x' THEN 0.0 WHEN 'y' THEN -uz ELSE uy END AS cx, CASE weak WHEN 'x' THEN uz WHEN 'y' THEN 0.0 ELSE -ux END AS cy,
    CASE weak WHEN 'x' THEN -uy WHEN 'y' THEN ux ELSE 0.0 END AS cz
  FROM (SELECT *, CASE WHEN abs(ux) <= abs(uy) AND abs(ux) <= abs(uz) THEN 'x' WHEN abs(uy) <= abs(uz) THEN 'y' ELSE 'z' END AS weak
  FROM (SELECT *, ax / al AS ux, ay / al AS uy, az / al AS uz, bend IS NULL OR NOT al > 0 AS still
  FROM (SELECT c.tree, c.id, c.bend, c.turn, c.vx, c.vy, c.vz, sqrt(c.vx*c.vx+c.vy*c.vy+c.vz*c.vz) AS len, p.ex AS sx, p.ey AS sy, p.ez AS sz,
    p.ex - p.sx AS ax, p.ey - p.sy AS ay, p.ez - p.sz AS az, sqrt(pow(p.ex-p.sx,2)+pow(p.ey-p.sy,2)+pow(p.ez-p.sz,2)) AS al
  FROM plc p JOIN trn c ON c.tree = p.tree AND c.parent_id = p.id))))))"""


@register("junction_geometry", with_sql(FOREST_SQL, TURNS, recursive=True, body="""
SELECT tree, id, round(ex, 5) + 0.0 AS dx, round(ey, 5) + 0.0 AS dy, round(ez, 5) + 0.0 AS dz, round(sqrt(pow(ex-sx,2)+pow(ey-sy,2)+pow(ez-sz,2)), 5) AS length_mm FROM plc"""))
def junction_geometry(spark, sf):
    out = growth.junction_geometry(forest(spark, sf), GAMMA)
    return out.select("tree", "id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("dx", "dy", "dz", "length_mm")])


@register("ends_pulled_into_domain", with_sql(FOREST_SQL, DEPTH_SQL, """
rd AS (SELECT *, sqrt(pow(dx-50,2)+pow(dy-50,2)+pow(dz-50,2)) AS q, sqrt(pow(px-50,2)+pow(py-50,2)+pow(pz-50,2)) AS w FROM seg),
mv AS (SELECT tree, id, parent_id, CASE WHEN q <= 55 THEN dx ELSE 50+(dx-50)*55/q END AS dx, CASE WHEN q <= 55 THEN dy ELSE 50+(dy-50)*55/q END AS dy, CASE WHEN q <= 55 THEN dz ELSE 50+(dz-50)*55/q END AS dz,
  CASE WHEN w <= 55 THEN px ELSE 50+(px-50)*55/w END AS px, CASE WHEN w <= 55 THEN py ELSE 50+(py-50)*55/w END AS py, CASE WHEN w <= 55 THEN pz ELSE 50+(pz-50)*55/w END AS pz FROM rd)""", recursive=True, body="""
SELECT tree, id, round(px, 5) AS px, round(dx, 5) AS dx, round(sqrt(pow(dx-px,2)+pow(dy-py,2)+pow(dz-pz,2)), 5) AS length_mm FROM mv"""))
def pulled(spark, sf):
    out = growth.pulled_inside(forest(spark, sf), BALL)
    return out.select("tree", "id", F.round("px", 5).alias("px"), F.round("dx", 5).alias("dx"), F.round("length_mm", 5).alias("length_mm"))


@register("ends_pulled_into_shell")
def pulled_shell(spark, sf):
    out = growth.pulled_inside(forest(spark, sf), domains.EllipsoidShell((50.0, 50.0, 50.0), (55.0, 50.0, 45.0), 0.4))
    return out.select("tree", "id", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "dz")])


def starts(spark, sf):
    return stats.tree_config(forest(spark, sf), shares={"LAD": 0.40, "LCX": 0.25, "RCA": 0.35})


@register("territory_partition")
def partition(spark, sf):
    owned, _ = territory.territories(starts(spark, sf), twigs(spark, sf), BALL, tree_weight=0.5, clean=True)
    return owned.select("i", "j", "k", "inside", "owner")


CELLS_SQL = """cl AS (SELECT tree, CAST(least(greatest(floor(px/10)+1,1),10) AS INTEGER) AS i, CAST(least(greatest(floor(py/10)+1,1),10) AS INTEGER) AS j, CAST(least(greatest(floor(pz/10)+1,1),10) AS INTEGER) AS k FROM twig),
ct AS (SELECT i, j, k, tree, count(*) AS n FROM cl GROUP BY 1, 2, 3, 4), ow AS (SELECT i, j, k, arg_min(tree, (-n, tree)) AS owner FROM ct GROUP BY 1, 2, 3)"""


def owned_cells(spark, sf):
    """Owner of a cell: the tree with most segments in it."""
    from arborlake.operators.voxels import Grid

    grid = Grid((0.0, 0.0, 0.0), (10.0, 10.0, 10.0), (10, 10, 10))
    cells = twigs(spark, sf).withColumns(dict(zip(("i", "j", "k"), territory.cell_of(triple("px", "py", "pz"), grid))))
    counts = cells.groupBy("i", "j", "k", "tree").agg(F.count("*").alias("n"))
    return counts.groupBy("i", "j", "k").agg(F.min_by("tree", F.struct(-F.col("n"), F.col("tree"))).alias("owner")), grid


@register("territory_of_point", with_sql(TWIGS_SQL, POINTS_SQL, CELLS_SQL, body="""
SELECT qid, owner FROM pt JOIN ow ON ow.i = least(greatest(floor(x/10)+1,1),10) AND ow.j = least(greatest(floor(y/10)+1,1),10) AND ow.k = least(greatest(floor(z/10)+1,1),10)"""))
def point_owner(spark, sf):
    owned, grid = owned_cells(spark, sf)
    return territory.owner_of(points(spark, sf), owned, grid).select("qid", "owner")


@register("territory_diagnostics", with_sql(TWIGS_SQL, CELLS_SQL, """
cn AS (SELECT i, j, k, owner, (i-0.5)*10 AS x, (j-0.5)*10 AS y, (k-0.5)*10 AS z FROM ow), nt AS (SELECT q.i, q.j, q.k, q.owner, arg_min(s.tree, (DIST, s.tree, s.id)) AS near FROM cn q, twig s GROUP BY 1, 2, 3, 4)""", body="""
SELECT owner, count(*) AS n, round(avg(CASE WHEN near <> owner THEN 1.0 ELSE 0 END), 9) AS mismatch, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM nt GROUP BY 1""").replace(
    "DIST", __import__("arborlake.catalog.q_spatial", fromlist=["dist_sql"]).dist_sql()))
def diagnostics(spark, sf):
    owned, grid = owned_cells(spark, sf)
    centred = owned.withColumns({a: (F.col(v) - 0.5) * 10 for a, v in zip("xyz", ("i", "j", "k"))}).withColumn("inside", F.lit(True))
    out = territory.diagnostics(centred, twigs(spark, sf))
    return out.select("owner", "n", F.round("mismatch", 9).alias("mismatch"), F.round("share", 9).alias("share"))


@register("draws_per_segment")
def all_draws(spark, sf):
    key = [F.col("tree"), F.col("id")]
    params = morphometry.order_params(spark)
    segs = stats.class_order(forest(spark, sf), params).withColumnRenamed("strahler_order", "ord")
    met = segs.join(F.broadcast(params), ["artery", "ord"])
    return met.select(
        "tree", "id", "ord", draws.beta(draws.uniform(key, 3)).alias("asymmetry"),
        draws.truncated_lognormal(F.col("l_mean"), F.col("l_sd"), key, 4).alias("length_um"),
        draws.truncated_normal(F.col("d_mean_elem"), F.col("d_sd_elem"), key, 5).alias("diameter_um"),
        draws.poisson(F.lit(2.75), draws.uniform(key, 6)).alias("children"),
        draws.weighted_pick(F.array(F.lit(0.151), F.lit(0.802), F.lit(2.15)), F.array(F.lit(0), F.lit(1), F.lit(2)), draws.uniform(key, 7)).alias("picked"))


@register("end_clipped_to_domain", with_sql(FOREST_SQL, """
ab AS (SELECT tree, id, px, py, pz, dx, dy, dz, sqrt(pow(px-50,2)+pow(py-50,2)+pow(pz-50,2)) AS q0, sqrt(pow(dx-50,2)+pow(dy-50,2)+pow(dz-50,2)) AS q1,
  pow(dx-px,2)+pow(dy-py,2)+pow(dz-pz,2) AS a, (px-50)*(dx-px)+(py-50)*(dy-py)+(pz-50)*(dz-pz) AS b FROM seg),
tt AS (SELECT *, CASE WHEN q1 <= 55 THEN 1.0 WHEN q0 <= 55 THEN 0.999 * (-b + sqrt(b*b - a*(q0*q0-55*55)))/a END AS t FROM ab)""", body="""
SELECT tree, id, round(CASE WHEN t IS NULL THEN 50+(dx-50)*55/q1 ELSE px+t*(dx-px) END, 4) AS x, round(CASE WHEN t IS NULL THEN 50+(dy-50)*55/q1 ELSE py+t*(dy-py) END, 4) AS y FROM tt"""))
def clipped(spark, sf):
    x, y, _ = BALL.clip(triple("px", "py", "pz"), triple("dx", "dy", "dz"))
    return forest(spark, sf).select("tree", "id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


EXPECT = "ex(artery, ord, expected) AS (VALUES " + ",".join(
    f"('{a}', {o}, {v})" for a, (orders, rates) in morphometry.PRESETS.items()
    for o, v in (lambda t: [t.append(__import__('math').ceil(1 + sum(r * (1 + t[m]) for m, r in rates.get(p, {}).items() if m < p))) for p in range(1, len(orders))] and list(enumerate(t)))([1])) + ")"


@register("expected_rows_after_expansion", with_sql(FOREST_SQL, PRM, ORD_SQL, EXPECT, "lf AS (SELECT r.* FROM ranked r ANTI JOIN seg c ON c.tree = r.tree AND c.parent_id = r.id)", body="""
SELECT s.tree, CAST(ceil((s.n + coalesce(l.e, 0)) * 1.5) AS BIGINT) AS rows FROM (SELECT tree, count(*) AS n FROM seg GROUP BY 1) s LEFT JOIN
 (SELECT tree, sum(e.expected - 1) AS e FROM lf JOIN ex e ON e.artery = lf.tree AND e.ord = lf.o WHERE lf.o > 0 GROUP BY 1) l ON l.tree = s.tree"""))
def expected(spark, sf):
    params = morphometry.order_params(spark)
    return synth.expected_total(stats.class_order(forest(spark, sf), params), params, morphometry.connectivity(spark))


@register("terminals_expanded")
def expanded(spark, sf):
    params = morphometry.order_params(spark)
    segs = stats.class_order(forest(spark, sf), params)
    new = synth.expand_terminals(segs, params, morphometry.connectivity(spark), GAMMA, seed=11)
    return new.select("tree", "id", "parent_id", "strahler_order", sig(F.col("radius_mm"), 6).alias("radius_mm"), sig(F.col("length_mm"), 6).alias("length_mm"), "generation")


@register("terminals_expanded_full_depth_in_domain")
def expanded_inside(spark, sf):
    params = morphometry.order_params(spark)
    segs = stats.class_order(forest(spark, sf), params)
    new = synth.expand_terminals(segs, params, morphometry.connectivity(spark), GAMMA, seed=12, domain=BALL, full_depth=True)
    return new.select("tree", "id", "parent_id", "strahler_order", sig(F.col("radius_mm"), 6).alias("radius_mm"), sig(F.col("length_mm"), 6).alias("length_mm"),
                      *[F.round(c, 5).alias(c) for c in ("dx", "dy", "dz")], "generation")


def cloud_box(spark, sf):
    """Shell whose size follows the points of the tables."""
    lo, hi = points(spark, sf).agg(F.min("x"), F.max("x")).first()
    half = (hi - lo) / 2
    return domains.EllipsoidShell(((lo + hi) / 2, 50.0, 50.0), (half, half * 0.9, half * 0.8), 0.4)


@register("places_sampled_in_domain")
def places(spark, sf):
    shell, n = cloud_box(spark, sf), points(spark, sf).count()
    a = synth.rejected_into(spark, shell, n, 10 * n, 5).withColumn("kind", F.lit("rejected"))
    b = synth.shell_points(spark, shell, n, 6).withColumn("kind", F.lit("direct"))
    stored = points(spark, sf).withColumn("pos", F.col("qid")).drop("qid")
    c = synth.picked(stored, "pos", n, n, 8).drop("pos").withColumn("kind", F.lit("stored"))
    owned, grid = owned_cells(spark, sf)
    d = synth.in_territory(spark, shell, owned, grid, "LAD", n, 100, 9).withColumn("kind", F.lit("territory"))
    return a.unionByName(b).unionByName(c).unionByName(d)


@register("sampled_volume")
def volume(spark, sf):
    return synth.sampled_volume(spark, cloud_box(spark, sf), 200 * points(spark, sf).count(), 4)
