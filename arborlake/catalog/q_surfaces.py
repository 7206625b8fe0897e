"""Registered queries: surface sampling, tubes, shells, trees of lines."""

from pyspark.sql import functions as F

from arborlake.catalog.bed import LINES_SQL, lines, points, sig, table, with_sql
from arborlake.catalog.q_trees import FOREST_SQL
from arborlake.operators import lines as L, surfaces as N

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def nets(spark, sf):
    """One tube per supplier: 4 rows along, 5 columns around, the last column on the first."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))
    named = s.withColumn("surface", F.concat(F.lit("tube_"), F.col("key").cast("string")))
    surfaces = named.select("surface", F.lit(4).alias("m"), F.lit(5).alias("n"))
    ks = [F.struct(F.lit(d).alias("dir"), F.lit(i + 1).alias("idx"), F.lit(v).alias("value"))
          for d, vals in (("u", N.open_uniform_knots(5, 4)), ("v", N.open_uniform_knots(4, 3))) for i, v in enumerate(vals)]
    knots = named.select("surface", F.inline(F.array(*ks)))
    grid = named.withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(5))))
    turn = F.element_at(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0), (1.0, 0.0))]), F.col("col"))
    r = 2.0 + F.col("key") % 3
    pts = grid.select("surface", "row", "col", ((F.col("key") % 10) * 10 + r * turn[0]).alias("x"), (F.floor(F.col("key") / 10) * 10 + r * turn[1]).alias("y"),
                      ((F.col("row") - 1) * 5 + F.col("bal") / 1000 + (F.col("row") * F.col("key")) % 4).cast("double").alias("z"))
    return surfaces, knots, pts


NET_SQL = """sp AS (SELECT s_suppkey AS key, s_acctbal AS bal, 'tube_' || s_suppkey AS surface, CAST(2.0 + s_suppkey % 3 AS DOUBLE) AS r FROM supplier),
net AS (SELECT surface, row, col, (key % 10)*10 + r*([1.0,0.0,-1.0,0.0,1.0])[col] AS x, (key // 10)*10 + r*([0.0,1.0,0.0,-1.0,0.0])[col] AS y,
  CAST((row-1)*5 + bal/1000 + (row*key) % 4 AS DOUBLE) AS z FROM sp, range(1, 5) a(row), range(1, 6) b(col))"""


def _bern(n, i, t):
    from math import comb
    return f"({comb(n, i)} * pow({t}, {i}) * pow(1 - {t}, {n - i}))"


BV = "CASE row " + " ".join(f"WHEN {i + 1} THEN {_bern(3, i, 'pv')}" for i in range(4)) + " END"
BU = "CASE col " + " ".join(f"WHEN {i + 1} THEN {_bern(4, i, 'pu')}" for i in range(5)) + " END"
SAMPLE_SQL = f"""uv AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, i/7.0 AS u, j/5.0 AS v FROM range(0, 8) a(i), range(0, 6) b(j)),
ev AS (SELECT i, j, w, CASE w WHEN 1 THEN greatest(u-1e-4, 0.0) WHEN 2 THEN least(u+1e-4, 1.0) ELSE u END AS pu, CASE w WHEN 3 THEN greatest(v-1e-4, 0.0) WHEN 4 THEN least(v+1e-4, 1.0) ELSE v END AS pv FROM uv, range(0, 5) c(w)),
vl AS (SELECT surface, i, j, w, sum(x*({BU})*({BV})) AS x, sum(y*({BU})*({BV})) AS y, sum(z*({BU})*({BV})) AS z FROM net, ev GROUP BY 1, 2, 3, 4),
pv AS (SELECT surface, i, j, {', '.join(f'max(CASE WHEN w = {n} THEN {a} END) AS {a}{n}' for n in range(5) for a in 'xyz')} FROM vl GROUP BY 1, 2, 3),
nm AS (SELECT *, (y2-y1)*(z4-z3)-(z2-z1)*(y4-y3) AS nx, (z2-z1)*(x4-x3)-(x2-x1)*(z4-z3) AS ny, (x2-x1)*(y4-y3)-(y2-y1)*(x4-x3) AS nz FROM pv),
nl AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM nm)"""


@register("surface_samples_and_normals", with_sql(NET_SQL, SAMPLE_SQL, body="""
SELECT surface, i, j, round(x0, 6) AS x, round(y0, 6) AS y, round(z0, 6) AS z, round(CASE WHEN l > 0 THEN nx/l ELSE 0 END, 4) + 0.0 AS nx, round(CASE WHEN l > 0 THEN nz/l ELSE 1 END, 4) + 0.0 AS nz FROM nl"""))
def samples(spark, sf):
    s = N.sample(*nets(spark, sf), F.lit(8), F.lit(6))
    return s.select("surface", "i", "j", *[F.round(a, 6).alias(a) for a in "xyz"], (F.round("nx", 4) + 0.0).alias("nx"), (F.round("nz", 4) + 0.0).alias("nz"))


@register("sampled_surface_round_trip", with_sql(NET_SQL, SAMPLE_SQL, body="""
SELECT surface, CAST(j*8 + i + 1 AS BIGINT) AS id, round(x0, 6) AS x, round(y0, 6) AS y, round(z0, 6) AS z, round(CASE WHEN l > 0 THEN nx/l ELSE 0 END, 4) + 0.0 AS nx FROM nl"""))
def sampled_surface(spark, sf):
    """Point and normal tables of surface samples, written in row order and paired again by row."""
    from arborlake.catalog.q_files import fresh
    from arborlake.sources import tables

    paths = fresh(spark, "samples"), fresh(spark, "sample-normals")
    tables.write_sampled_surface(N.sample(*nets(spark, sf), F.lit(8), F.lit(6)), *paths)
    s = tables.surface_points(*[tables.read_sampled_surface(spark, p) for p in paths])
    return s.select("surface", "id", *[F.round(a, 6).alias(a) for a in "xyz"], (F.round("nx", 4) + 0.0).alias("nx"))


@register("surface_summary", with_sql(NET_SQL, body="""
SELECT surface, count(*) AS n_points, 4 AS p_u, 3 AS p_v, 'v' AS axial, round(min(x), 6) AS x_min, round(max(z), 6) AS z_max FROM net GROUP BY 1"""))
def surface_summary(spark, sf):
    s, k, p = nets(spark, sf)
    box = p.groupBy("surface").agg(F.count("*").alias("n_points"), F.round(F.min("x"), 6).alias("x_min"), F.round(F.max("z"), 6).alias("z_max"))
    return box.join(N.degrees(s, k), "surface").join(N.axes(s, p), "surface").select("surface", "n_points", "p_u", "p_v", "axial", "x_min", "z_max")


CENTER_SQL = f"""ring AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, i/11.0 AS pu, j/15.0 AS pv FROM range(0, 12) a(i), range(0, 16) b(j)),
pl AS (SELECT surface, i, j, sum(x*({BU})*({BV})) AS x, sum(y*({BU})*({BV})) AS y, sum(z*({BU})*({BV})) AS z FROM net, ring GROUP BY 1, 2, 3),
ce AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, avg(z) OVER w AS cz FROM pl WINDOW w AS (PARTITION BY surface, j)),
li AS (SELECT surface AS line, j + 1 AS pos, any_value(cx) AS x, any_value(cy) AS y, any_value(cz) AS z, avg(sqrt(pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2))) AS radius_mm FROM ce GROUP BY 1, 2)"""


@register("tube_centerlines", with_sql(NET_SQL, CENTER_SQL, body="SELECT line, pos, round(x, 6) AS x, round(z, 6) AS z, round(radius_mm, 6) AS radius_mm FROM li"))
def centerlines(spark, sf):
    c = N.tube_centerlines(*nets(spark, sf), ring=12)
    return c.select("line", "pos", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"), F.round("radius_mm", 6).alias("radius_mm"))


@register("shell_domain_from_surfaces")
def shell_domain(spark, sf):
    """Outer wall and cavity as one-patch surfaces around the query points, interior points and volume."""
    lo, hi = points(spark, sf).agg(F.min("x"), F.max("x")).first()
    surfaces, knots, pts = sphere_nets(spark, sf, (lo + hi) / 2, (hi - lo) / 2)
    cloud = N.shell_from_surfaces(surfaces, knots, pts, 24, 24)
    n = points(spark, sf).count()
    inside, volume = N.interior_points(cloud, "outer", ["cavity"], n, 4 * n, 3)
    return inside.select("qid", "x", "y", "z", F.round("shell_sd", 6).alias("shell_sd")).withColumn("volume", volume)


def sphere_nets(spark, sf, centre, radius):
    """Degree-1 nets of two spheres, 13 rows by 17 columns."""
    import math

    both = table(spark, sf, "region").select(F.col("r_regionkey").alias("k")).where("k < 2").select(
        F.when(F.col("k") == 0, "outer").otherwise("cavity").alias("surface"), (radius * F.when(F.col("k") == 0, 1.0).otherwise(0.4)).alias("r"))
    surfaces = both.select("surface", F.lit(13).alias("m"), F.lit(17).alias("n"))
    ks = [F.struct(F.lit(d).alias("dir"), F.lit(i + 1).alias("idx"), F.lit(v).alias("value"))
          for d, vals in (("u", N.open_uniform_knots(17, 1)), ("v", N.open_uniform_knots(13, 1))) for i, v in enumerate(vals)]
    grid = both.withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(13)))).withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(17))))
    t, a = (F.col("row") - 1) * math.pi / 12, (F.col("col") - 1) * 2 * math.pi / 16
    pts = grid.select("surface", "row", "col", (centre + F.col("r") * F.sin(t) * F.cos(a)).alias("x"), (50 + F.col("r") * F.sin(t) * F.sin(a)).alias("y"), (50 + F.col("r") * F.cos(t)).alias("z"))
    return surfaces, both.select("surface", F.inline(F.array(*ks))), pts


@register("trees_assembled_from_lines")
def assembled(spark, sf):
    """Groups of up to five lines become trees: the second is the root, the first its reference, the rest children of the line before."""
    pts = lines(spark, sf).withColumn("grp", F.floor(F.col("line") / 5))
    names = pts.groupBy("grp").agg(F.array_sort(F.collect_set("line")).alias("ls"))  # at most five
    names = names.withColumn("tree", F.concat(F.lit("T"), F.col("grp").cast("string")))
    roots = names.select("tree", F.element_at("ls", F.least(F.size("ls"), F.lit(2))).alias("line"), F.element_at("ls", 1).alias("reference"))
    conn = names.where(F.size("ls") > 2).select("tree", F.explode(F.transform(
        F.slice("ls", 3, 3), lambda c, i: F.struct(F.element_at("ls", i + 2).alias("parent"), c.alias("child")))).alias("c")).select("tree", "c.parent", "c.child")
    placed, joint = L.assemble(pts.drop("grp"), roots, conn)
    owned = roots.select("tree", "line").unionByName(conn.select("tree", F.col("child").alias("line")))
    segs = L.tree_segments(placed, owned, joint.drop("tree"))
    return segs.select("tree", "id", "parent_id", *[F.round(c, 6).alias(c) for c in ("px", "dx", "radius_mm")])


@register("segment_facets", with_sql(FOREST_SQL, """
ax AS (SELECT tree, id, px, py, pz, dx, dy, dz, radius_mm AS r, length_mm AS l, (dx-px)/length_mm AS ax, (dy-py)/length_mm AS ay, (dz-pz)/length_mm AS az FROM seg WHERE length_mm > 0),
e AS (SELECT *, CASE WHEN abs(ax) <= abs(ay) AND abs(ax) <= abs(az) THEN 0 WHEN abs(ay) <= abs(az) THEN 1 ELSE 2 END AS k FROM ax),
q AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 1 THEN -az ELSE ay END AS ux0, CASE k WHEN 0 THEN az WHEN 1 THEN 0 ELSE -ax END AS uy0, CASE k WHEN 0 THEN -ay WHEN 1 THEN ax ELSE 0 END AS uz0 FROM e),
u AS (SELECT *, ux0/sqrt(ux0*ux0+uy0*uy0+uz0*uz0) AS ux, uy0/sqrt(ux0*ux0+uy0*uy0+uz0*uz0) AS uy, uz0/sqrt(ux0*ux0+uy0*uy0+uz0*uz0) AS uz FROM q),
v AS (SELECT *, ay*uz-az*uy AS vx, az*ux-ax*uz AS vy, ax*uy-ay*ux AS vz FROM u)""", body="""
SELECT tree, id, CAST(s AS INTEGER) AS side, CAST(h AS INTEGER) AS half, round(CASE h WHEN 0 THEN px + r*(cos(2*pi()*s/6)*ux+sin(2*pi()*s/6)*vx) ELSE px + r*(cos(2*pi()*((s+1)%6)/6)*ux+sin(2*pi()*((s+1)%6)/6)*vx) END, 6) AS ax,
 round(dx + r*(cos(2*pi()*s/6)*ux+sin(2*pi()*s/6)*vx), 6) AS bx FROM v, range(0, 6) a(s), range(0, 2) b(h)"""))
def facets(spark, sf):
    from arborlake.catalog.bed import forest

    f = N.facets(forest(spark, sf).where("length_mm > 0"), 6)
    return f.select("tree", "id", "side", "half", F.round("a.x", 6).alias("ax"), F.round("b.x", 6).alias("bx"))
