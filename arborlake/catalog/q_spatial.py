"""Registered queries: spatial operators."""

from pyspark.sql import functions as F

from arborlake.catalog.bed import POINTS_SQL, TWIGS_SQL, forest, points, sig, sig_sql, table, twigs, with_sql
from arborlake.functions import flow
from arborlake.operators import spatial, trees

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def dist_sql(q=("x", "y", "z"), s="s", p=("px", "py", "pz"), d=("dx", "dy", "dz"), qa="q") -> str:
    """Point to segment distance as SQL text."""
    ax = [f"({s}.{b}-{s}.{a})" for a, b in zip(p, d)]
    rel = [f"({qa}.{c}-{s}.{a})" for c, a in zip(q, p)]
    len2 = "(" + "+".join(f"{a}*{a}" for a in ax) + ")"
    t = f"(CASE WHEN {len2} < 1e-30 THEN 0.0 ELSE least(greatest(({'+'.join(f'{r}*{a}' for r, a in zip(rel, ax))})/{len2},0.0),1.0) END)"
    return "sqrt(" + "+".join(f"pow({r}-{t}*{a},2)" for r, a in zip(rel, ax)) + ")"


@register("point_to_segment_distance", with_sql(TWIGS_SQL, "c AS (SELECT 50.0 AS x, 50.0 AS y, 50.0 AS z)", body=f"""
SELECT s.tree, s.id, round({dist_sql()}, 6) AS distance FROM twig s, c q"""))
def point_segment(spark, sf):
    return spatial.distance_to_place(twigs(spark, sf), (50.0, 50.0, 50.0)).select("tree", "id", F.round("distance", 6).alias("distance"))


@register("k_nearest_segments", with_sql(TWIGS_SQL, POINTS_SQL, f"""
m AS (SELECT q.qid, s.tree, s.id, {dist_sql()} AS d FROM pt q, twig s),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tree, id) AS rank FROM m)""", body="""
SELECT qid, CAST(rank AS INTEGER) AS rank, tree, id, round(d, 6) AS distance FROM r WHERE rank <= 3"""))
def k_nearest(spark, sf):
    out = spatial.nearest_segments(points(spark, sf), twigs(spark, sf), 3)
    return out.select("qid", "rank", "tree", "id", F.round("distance", 6).alias("distance"))


@register("segments_in_range", with_sql(TWIGS_SQL, POINTS_SQL, f"""
m AS (SELECT q.qid, s.tree, s.id, {dist_sql()} AS d FROM pt q, twig s)""", body="""
SELECT qid, tree, id, round(d, 6) AS distance FROM m WHERE d <= 6"""))
def in_range(spark, sf):
    out = spatial.segments_in_range(points(spark, sf), twigs(spark, sf), 6.0)
    return out.select("qid", "tree", "id", F.round("distance", 6).alias("distance"))


def clouds(spark, sf):
    """Two sampled spheres: an outer wall and a cavity, with outward normals."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("t"), F.col("o_totalprice").alias("v"))
    z = (F.col("v") % 1000) / 500 - 1
    a = F.col("v") / 7
    ring = F.sqrt(F.greatest(1 - z * z, F.lit(0.0)))
    o = o.withColumns({"nx": ring * F.cos(a), "ny": ring * F.sin(a), "nz": z})
    r = F.when(F.col("t") == 0, 45.0).otherwise(20.0)
    return o.select(F.when(F.col("t") == 0, "outer").otherwise("cavity").alias("surface"), "id",
                    *[(50 + r * F.col(f"n{c}")).alias(c) for c in "xyz"], "nx", "ny", "nz")


CLOUD_SQL = """cl0 AS (SELECT o_orderkey AS id, o_orderkey % 2 AS t, (o_totalprice % 1000) / 500 - 1 AS nz, o_totalprice / 7 AS a
  FROM orders),
cl1 AS (SELECT *, sqrt(greatest(1 - nz*nz, 0.0)) * cos(a) AS nx, sqrt(greatest(1 - nz*nz, 0.0)) * sin(a) AS ny,
  CASE t WHEN 0 THEN 45.0 ELSE 20.0 END AS r FROM cl0),
cloud AS (SELECT CASE t WHEN 0 THEN 'outer' ELSE 'cavity' END AS surface, id, 50 + r*nx AS x, 50 + r*ny AS y, 50 + r*nz AS z,
  nx, ny, nz FROM cl1)"""
NEAR_SQL = """nr AS (SELECT q.qid, c.surface, c.id AS sid,
  (q.x-c.x)*(q.x-c.x) + (q.y-c.y)*(q.y-c.y) + (q.z-c.z)*(q.z-c.z) AS d2,
  (q.x-c.x)*c.nx + (q.y-c.y)*c.ny + (q.z-c.z)*c.nz AS off, q.x, q.y, q.z, c.nx, c.ny, c.nz FROM pt q, cloud c),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, surface ORDER BY d2, sid) AS rn FROM nr) WHERE rn = 1)"""


@register("nearest_surface_point_and_offset", with_sql(POINTS_SQL, CLOUD_SQL, NEAR_SQL, body="""
SELECT qid, surface, sid, round(sqrt(d2), 6) AS distance, round(off, 6) AS signed_offset FROM nn"""))
def surface_offset(spark, sf):
    asked = points(spark, sf).withColumn("surface", F.explode(F.array(F.lit("outer"), F.lit("cavity"))))
    out = spatial.nearest_surface_point(asked, clouds(spark, sf))
    return out.select("qid", "surface", "sid", F.round(F.sqrt("d_sq"), 6).alias("distance"), F.round("offset", 6).alias("signed_offset"))


@register("shell_with_cavities_distance", with_sql(POINTS_SQL, CLOUD_SQL, NEAR_SQL, body="""
SELECT qid, round(max(CASE surface WHEN 'outer' THEN off ELSE -off END), 6) AS shell_sd,
 round(max(CASE surface WHEN 'outer' THEN off END), 6) AS outer_sd,
 round(max(CASE surface WHEN 'cavity' THEN -off END), 6) AS worst_cavity_sd, 'cavity' AS worst_cavity FROM nn GROUP BY qid"""))
def shell(spark, sf):
    out = spatial.shell_distance(points(spark, sf), clouds(spark, sf), "outer", ["cavity"])
    return out.select("qid", *[F.round(c, 6).alias(c) for c in ("shell_sd", "outer_sd", "worst_cavity_sd")], "worst_cavity")


@register("shell_projection", with_sql(POINTS_SQL, CLOUD_SQL, NEAR_SQL, """
v AS (SELECT *, CASE surface WHEN 'outer' THEN off ELSE -off END AS viol FROM nn),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY viol DESC, surface DESC) AS k FROM v)""", body="""
SELECT qid, round(x + st*nx, 5) AS x, round(y + st*ny, 5) AS y, round(z + st*nz, 5) AS z FROM
(SELECT *, CASE WHEN viol <= 0 THEN 0.0 WHEN surface = 'outer' THEN -off ELSE -off + 1e-6 END AS st FROM w WHERE k = 1)"""))
def shell_projection(spark, sf):
    out = spatial.project_to_shell(points(spark, sf), clouds(spark, sf), "outer", ["cavity"])
    return out.select("qid", *[F.round(c, 5).alias(c) for c in "xyz"])


def _turns(repeats=3):
    """Each turn: the nearest sample of every place, then the place moved back along its normal if it lies outside."""
    out = ["p0 AS (SELECT qid, surface, x, y, z FROM pt, (VALUES ('outer'), ('cavity')) s(surface))"]
    for turn in range(repeats + 1):
        push = "off" if turn == 0 else "(off + 1e-6)"
        out.append(f"""n{turn} AS (SELECT p.qid, p.surface, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.z) AS z,
  min({{'d2': (p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z), 'id': c.id, 'nx': c.nx, 'ny': c.ny, 'nz': c.nz, 'off': (p.x-c.x)*c.nx + (p.y-c.y)*c.ny + (p.z-c.z)*c.nz}}) AS m
  FROM p{turn} p JOIN cloud c ON c.surface = p.surface GROUP BY 1, 2)""")
        out.append(f"p{turn + 1} AS (SELECT qid, surface, {', '.join(f'CASE WHEN off > 0 THEN {a} - {push} * m.n{a} ELSE {a} END AS {a}' for a in 'xyz')} FROM (SELECT *, m.off AS off FROM n{turn}))")
    return out


@register("surface_projection_repeated", with_sql(POINTS_SQL, CLOUD_SQL, *_turns(), body="SELECT qid, surface, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM p4"))
def surface_projection(spark, sf):
    asked = points(spark, sf).withColumn("surface", F.explode(F.array(F.lit("outer"), F.lit("cavity"))))
    out = spatial.project_to_surface(asked, clouds(spark, sf))
    return out.select("qid", "surface", *[F.round(c, 5).alias(c) for c in "xyz"])


@register("nearest_tree_of_point", with_sql(TWIGS_SQL, POINTS_SQL, f"""
m AS (SELECT q.qid, s.tree, s.id, {dist_sql()} AS d FROM pt q, twig s)""", body="""
SELECT qid, arg_min(tree, (d, tree, id)) AS nearest_tree, round(min(d), 6) AS distance FROM m GROUP BY qid"""))
def nearest_tree(spark, sf):
    return spatial.nearest_tree(points(spark, sf), twigs(spark, sf)).select("qid", "nearest_tree", F.round("distance", 6).alias("distance"))


@register("inter_tree_collision", with_sql(TWIGS_SQL, f"""
e AS (SELECT tree, id, dx AS x, dy AS y, dz AS z FROM twig),
m AS (SELECT q.tree, q.id, {dist_sql()} AS d FROM e q JOIN twig s ON s.tree <> q.tree
   AND s.px BETWEEN q.x - 3 AND q.x + 3 AND s.py BETWEEN q.y - 3 AND q.y + 3 AND s.pz BETWEEN q.z - 3 AND q.z + 3)""", body="""
SELECT tree, id, round(min(d), 6) AS distance FROM m WHERE d < 1.5 GROUP BY 1, 2"""))
def collision(spark, sf):
    return spatial.collisions(twigs(spark, sf), 1.5).select("tree", "id", F.round("distance", 6).alias("distance"))


SEGSEG_SQL = """
v AS (SELECT a.tree AS a_tree, a.id AS a_id, b.tree AS b_tree, b.id AS b_id,
  a.dx-a.px AS ux, a.dy-a.py AS uy, a.dz-a.pz AS uz, b.dx-b.px AS vx, b.dy-b.py AS vy, b.dz-b.pz AS vz,
  a.px-b.px AS wx, a.py-b.py AS wy, a.pz-b.pz AS wz
  FROM twig a JOIN twig b ON (a.tree, a.id) < (b.tree, b.id) AND b.px BETWEEN a.px - 3 AND a.px + 3
  AND b.py BETWEEN a.py - 3 AND a.py + 3 AND b.pz BETWEEN a.pz - 3 AND a.pz + 3),
dots AS (SELECT *, ux*ux+uy*uy+uz*uz AS a, vx*vx+vy*vy+vz*vz AS e, ux*vx+uy*vy+uz*vz AS b,
  ux*wx+uy*wy+uz*wz AS c, vx*wx+vy*wy+vz*wz AS f FROM v),
s1 AS (SELECT *, CASE WHEN a < 1e-30 THEN 0.0 WHEN e < 1e-30 THEN least(greatest(-c/a,0.0),1.0)
  WHEN a*e-b*b > 1e-30 THEN least(greatest((b*f-c*e)/(a*e-b*b),0.0),1.0) ELSE 0.0 END AS s0 FROM dots),
s2 AS (SELECT *, CASE WHEN e < 1e-30 THEN 0.0 ELSE (b*s0+f)/e END AS t0 FROM s1),
s3 AS (SELECT *, least(greatest(t0,0.0),1.0) AS t, CASE WHEN a < 1e-30 THEN 0.0 WHEN e < 1e-30 THEN s0
  WHEN t0 < 0 THEN least(greatest(-c/a,0.0),1.0) WHEN t0 > 1 THEN least(greatest((b-c)/a,0.0),1.0) ELSE s0 END AS s FROM s2),
near AS (SELECT a_tree, a_id, b_tree, b_id, sqrt(pow(wx+s*ux-t*vx,2)+pow(wy+s*uy-t*vy,2)+pow(wz+s*uz-t*vz,2)) AS d FROM s3)"""
ANC_SQL = """anc AS (SELECT tree, id AS leaf, id, parent_id, 0 AS h FROM seg UNION ALL
  SELECT a.tree, a.leaf, s.id, s.parent_id, a.h + 1 FROM anc a JOIN seg s ON s.tree = a.tree AND s.id = a.parent_id WHERE a.h < 8)"""


@register("segment_intersections_beyond_hops", with_sql(TWIGS_SQL, SEGSEG_SQL, ANC_SQL, """
hit AS (SELECT * FROM near WHERE d < 0.6),
hop AS (SELECT h.a_tree, h.a_id, h.b_id, min(x.h + y.h) AS hops FROM hit h
  JOIN anc x ON x.tree = h.a_tree AND x.leaf = h.a_id JOIN anc y ON y.tree = h.b_tree AND y.leaf = h.b_id AND y.id = x.id
  WHERE h.a_tree = h.b_tree GROUP BY 1, 2, 3)""", recursive=True, body="""
SELECT h.a_tree, h.a_id, h.b_tree, h.b_id, round(h.d, 5) AS distance FROM hit h LEFT JOIN hop p
ON p.a_tree = h.a_tree AND p.a_id = h.a_id AND p.b_id = h.b_id AND h.b_tree = h.a_tree
WHERE p.hops IS NULL OR p.hops > 8"""))
def intersections(spark, sf):
    return spatial.intersections(twigs(spark, sf), 0.6).select("a_tree", "a_id", "b_tree", "b_id", F.round("distance", 5).alias("distance"))


KIDS = """leafs AS (SELECT s.* FROM twig s ANTI JOIN twig c ON c.tree = s.tree AND c.parent_id = s.id)"""


@register("nearest_other_terminal_weight", with_sql(TWIGS_SQL, KIDS, """
m AS (SELECT a.tree, a.id, min(pow(a.dx-b.dx,2)+pow(a.dy-b.dy,2)+pow(a.dz-b.dz,2)) AS d2 FROM leafs a JOIN leafs b
  ON a.tree = b.tree AND a.id <> b.id GROUP BY 1, 2)""", body=f"""
SELECT tree, id, round(sqrt(d2), 6) AS nearest, {sig_sql('pow(sqrt(d2), 3) / sum(pow(sqrt(d2), 3)) OVER (PARTITION BY tree)', 7)} AS weight FROM m"""))
def terminal_weight(spark, sf):
    ends = trees.with_children(twigs(spark, sf)).where("is_terminal")
    return spatial.nearest_other_terminal(ends).select("tree", "id", F.round("nearest", 6).alias("nearest"), sig(F.col("weight"), 7).alias("weight"))


C = 2 ** (-1 / flow.GAMMA)
KAPPA = (1 - C) / C
PHI = (5**0.5 - 1) / 2


def _cost(t):
    return f"(r*{t}*len + {C}*r*(1-{t})*len + {C}*r*sqrt(pow(wx-{t}*len*ux,2)+pow(wy-{t}*len*uy,2)+pow(wz-{t}*len*uz,2)))"


# The closed-form optimum finds the few segments that can win; the search itself is repeated on those.
@register("best_connection_of_point", with_sql(TWIGS_SQL, POINTS_SQL, f"""
g AS (SELECT q.qid, s.tree, s.id, s.radius_mm AS r, s.length_mm AS len, q.x-s.px AS wx, q.y-s.py AS wy, q.z-s.pz AS wz,
  (s.dx-s.px)/s.length_mm AS ux, (s.dy-s.py)/s.length_mm AS uy, (s.dz-s.pz)/s.length_mm AS uz FROM pt q, twig s WHERE s.length_mm > 0),
h AS (SELECT *, wx*ux+wy*uy+wz*uz AS along, wx*wx+wy*wy+wz*wz AS w2 FROM g),
i AS (SELECT *, sqrt(greatest(w2-along*along, 0.0)) AS far FROM h),
j AS (SELECT *, least(greatest((along - far*{KAPPA}/sqrt(1-{KAPPA}*{KAPPA}))/len, 0.01), 0.99) AS t FROM i),
k AS (SELECT *, {_cost('t')} AS rough FROM j),
few AS (SELECT * FROM (SELECT *, min(rough) OVER (PARTITION BY qid) AS m FROM k) WHERE rough <= m * 1.01),
gold AS (SELECT qid, tree, id, r, len, wx, wy, wz, ux, uy, uz, CAST(0.01 AS DOUBLE) AS a, CAST(0.99 AS DOUBLE) AS b, 0 AS n FROM few
  UNION ALL SELECT qid, tree, id, r, len, wx, wy, wz, ux, uy, uz,
   CASE WHEN {_cost(f'(b-{PHI}*(b-a))')} < {_cost(f'(a+{PHI}*(b-a))')} THEN a ELSE b-{PHI}*(b-a) END,
   CASE WHEN {_cost(f'(b-{PHI}*(b-a))')} < {_cost(f'(a+{PHI}*(b-a))')} THEN a+{PHI}*(b-a) ELSE b END, n + 1 FROM gold WHERE n < 20),
fin AS (SELECT qid, tree, id, {_cost('((a+b)/2)')} AS cost FROM gold WHERE n = 20)""", recursive=True, body=f"""
SELECT qid, arg_min(tree, cost) AS tree, arg_min(id, cost) AS id, {sig_sql('min(cost)', 7)} AS cost FROM fin GROUP BY qid"""))
def connection(spark, sf):
    segs = twigs(spark, sf).where(F.col("length_mm") > 0)
    return spatial.best_connection(points(spark, sf), segs, flow.GAMMA).select("qid", "tree", "id", sig(F.col("cost"), 7).alias("cost"))


@register("merge_candidate_of_point", with_sql(TWIGS_SQL, POINTS_SQL, """
two AS (SELECT s.tree, s.id, s.dx, s.dy, s.dz, s.radius_mm * 60 AS r FROM twig s JOIN (SELECT tree, parent_id, count(*) AS n FROM twig
  GROUP BY 1, 2) k ON k.tree = s.tree AND k.parent_id = s.id AND k.n = 2),
c AS (SELECT q.qid, s.tree, s.id, 2*pi()*s.r/sqrt(pow(q.x-s.dx,2)+pow(q.y-s.dy,2)+pow(q.z-s.dz,2)) AS chi FROM pt q, two s)""", body=f"""
SELECT qid, arg_max(tree, chi) AS tree, arg_max(id, chi) AS id, {sig_sql('max(chi)', 8)} AS chi FROM c WHERE chi > 0.83 GROUP BY qid"""))
def merge(spark, sf):
    two = trees.with_children(twigs(spark, sf)).where("n_children = 2").withColumn("radius_mm", F.col("radius_mm") * 60)
    return spatial.merge_candidates(points(spark, sf), two).select("qid", "tree", "id", sig(F.col("chi"), 8).alias("chi"))
