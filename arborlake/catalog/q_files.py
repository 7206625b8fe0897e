"""Registered queries: sources and sinks, written to the shared work folder and read back."""

import uuid

from pyspark.sql import functions as F

from arborlake.catalog.bed import FOREST_SQL, LINES_SQL, POINTS_SQL, forest, lines, points, table, with_sql
from arborlake.catalog.q_surfaces import nets
from arborlake.operators import report, surfaces as N, trees
from arborlake.plans.cut import work_dir
from arborlake.sources import nets as net_files, runs, tables as S

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def fresh(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("segment_table_round_trip", with_sql(FOREST_SQL, body="SELECT tree, id, parent_id, px, dx, radius_mm, length_mm, flow_m3_s FROM (SELECT *, CAST(NULL AS DOUBLE) AS flow_m3_s FROM seg)"))
def segment_table(spark, sf):
    path = fresh(spark, "segments")
    S.write_segments(forest(spark, sf), path)
    return S.read_segments(spark, path).select("tree", "id", "parent_id", "px", "dx", "radius_mm", "length_mm", "flow_m3_s")


KID_SQL = """kd AS (SELECT tree, parent_id AS id, list(id ORDER BY id) AS ch FROM seg WHERE parent_id > 0 GROUP BY 1, 2)"""


@register("segment_csv_round_trip", with_sql(FOREST_SQL, KID_SQL, body="""
SELECT s.tree, s.id, s.px AS proximal_x, s.radius_mm AS radius, s.parent_id, coalesce(ch[1], -1) AS child1_id, coalesce(ch[2], -1) AS child2_id, coalesce(ch[3], -1) AS child3_id
FROM seg s LEFT JOIN kd k ON k.tree = s.tree AND k.id = s.id"""))
def segment_csv(spark, sf):
    path = fresh(spark, "csv")
    S.write_csv(forest(spark, sf), path)
    return S.read_csv(spark, path).select("tree", "id", "proximal_x", "radius", "parent_id", "child1_id", "child2_id", "child3_id")


@register("graph_json_round_trip", with_sql(FOREST_SQL, body="SELECT tree, id AS target, parent_id AS source, length_mm AS length, radius_mm AS radius, dx AS x FROM seg"))
def graph_json(spark, sf):
    path = fresh(spark, "graph")
    S.write_graph_json(forest(spark, sf), path)
    nodes, edges = S.read_graph_json(spark, path)
    return edges.join(nodes.select("tree", F.col("id").alias("target"), "x"), ["tree", "target"]).select("tree", "target", "source", "length", "radius", "x")


TEXT_SQL = """sl AS (SELECT *, row_number() OVER (PARTITION BY tree, parent_id ORDER BY id) AS slot FROM seg)"""


@register("edge_text_round_trip", with_sql(FOREST_SQL, TEXT_SQL, body="""
SELECT tree, id - 1 AS id, CASE WHEN parent_id > 0 THEN parent_id - 1 ELSE -1 END AS parent_id, CASE WHEN parent_id > 0 AND slot >= 2 THEN 'l' ELSE 'r' END AS side,
 CAST(printf('%.6f', radius_mm*2000) AS DOUBLE) AS diameter_um, CAST(printf('%.9f', length_mm*0.1) AS DOUBLE) AS length_cm, CAST(printf('%.9f', dz*0.1) AS DOUBLE) AS z FROM sl"""))
def edge_text(spark, sf):
    path = fresh(spark, "edges")
    S.write_edge_text(forest(spark, sf), path)
    rows = S.read_edge_text(spark, path)
    return rows.select("tree", "id", "parent_id", "side", "diameter_um", "length_cm", "z")


@register("rows_with_missing_parent", with_sql(FOREST_SQL, body="""
SELECT tree, id FROM (SELECT * FROM seg WHERE id % 97 <> 5) a WHERE parent_id >= 0 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM seg WHERE id % 97 <> 5) b WHERE b.tree = a.tree AND b.id = a.parent_id)"""))
def missing(spark, sf):
    return S.missing_parents(forest(spark, sf).where("id % 97 <> 5")).select("tree", "id")


@register("polyline_points_and_cells", with_sql(FOREST_SQL, body="""
SELECT tree, id*2 - 1 AS point_id, px AS x, id AS cell FROM seg UNION ALL SELECT tree, id*2, dx, id FROM seg"""))
def polylines(spark, sf):
    pts, cells = S.polyline_tables(forest(spark, sf))
    ends = cells.select("tree", F.col("id").alias("cell"), F.explode(F.array("from_point", "to_point")).alias("point_id"))
    return pts.join(ends, ["tree", "point_id"]).select("tree", "point_id", "x", "cell")


@register("xyz_points_and_normals", """SELECT o_orderkey + 1 AS id, o_totalprice / 10 AS x, round(CAST(1 + o_custkey % 3 AS DOUBLE) / sqrt(pow(1 + o_custkey % 3, 2) + 4 + pow(o_orderkey % 5, 2)), 9) AS nx FROM orders""")
def xyz(spark, sf):
    o = table(spark, sf, "orders").withColumn("surface", F.lit("s"))
    p, n = fresh(spark, "points"), fresh(spark, "normals")
    # Points and normals pair by row; both are written in the order of the same ranges, in any number of parts.
    ordered = o.repartitionByRange("surface", "o_orderkey").sortWithinPartitions("surface", "o_orderkey")
    ordered.select("surface", (F.col("o_totalprice") / 100).alias("x"), F.col("o_custkey").cast("double").alias("y"), F.lit(1.0).alias("z")).write.partitionBy("surface").csv(p)
    ordered.select("surface", (1 + F.col("o_custkey") % 3).cast("double").alias("x"), F.lit(2.0).alias("y"), (F.col("o_orderkey") % 5).cast("double").alias("z")).write.partitionBy("surface").csv(n)
    named = [S.read_xyz(spark, path, key="surface").withColumnRenamed("file", "surface") for path in (p, n)]
    return S.surface_points(*named, scale=10.0).select("id", F.round("x", 6).alias("x"), F.round("nx", 9).alias("nx"))


ORACLE["xyz_points_and_normals"] = ORACLE["xyz_points_and_normals"].replace("o_totalprice / 10 AS x", "round(o_totalprice / 10, 6) AS x")


@register("centerline_csv_round_trip", with_sql(LINES_SQL, body="""
SELECT grp, count(*) AS n, round(sum(x * pos), 4) AS checksum FROM (SELECT line % 8 AS grp, row_number() OVER (PARTITION BY line % 8 ORDER BY line, pos) AS pos, x FROM ln) GROUP BY 1"""))
def centerline_csv(spark, sf):
    """Eight long lines: all lines with the same remainder, one after the other."""
    from arborlake.plans.running import cumulative

    pts = lines(spark, sf).withColumns({"grp": F.col("line") % 8, "_o": F.col("line") * 100 + F.col("pos")})
    long = cumulative(pts.drop("pos"), ["grp"], "_o").select(F.col("grp").alias("line"), F.col("upto").alias("pos"), "x", "y", "z", "radius_mm")
    path = fresh(spark, "centerlines")
    S.write_centerlines(long, path)
    back = S.read_centerlines(spark, path)
    return back.groupBy(F.col("line").cast("bigint").alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("pos")), 4).alias("checksum"))


@register("control_net_text_round_trip", with_sql(__import__("arborlake.catalog.q_surfaces", fromlist=["NET_SQL"]).NET_SQL, body="""
SELECT surface, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM net"""))
def net_text(spark, sf):
    path = fresh(spark, "nets")
    net_files.write_nets(*nets(spark, sf), path)
    _, _, points = net_files.parse_nets(_in_order(spark, path))
    return points.select("surface", "row", "col", *[F.round(a, 6).alias(a) for a in "xyz"])


def _in_order(spark, path):
    """Lines of all part files of one folder as one numbered file."""
    from pyspark.sql import Window
    from arborlake.sources.lines import numbered

    rows = numbered(spark, path)
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(offsets, "file").select(F.lit("all").alias("file"), (F.col("pos") + F.col("before")).alias("pos"), "value")


@register("control_net_knots", with_sql("k AS (SELECT 'tube_' || s_suppkey AS surface FROM supplier), kn AS (SELECT 'u' AS dir, CAST(i AS INTEGER) AS idx, CASE WHEN i <= 5 THEN 0.0 ELSE 1.0 END AS value FROM range(1, 11) a(i) UNION ALL SELECT 'v', CAST(i AS INTEGER), CASE WHEN i <= 4 THEN 0.0 ELSE 1.0 END FROM range(1, 9) b(i))",
          body="SELECT surface, dir, idx, CAST(value AS DOUBLE) AS value FROM k, kn"))
def net_knots(spark, sf):
    path = fresh(spark, "nets")
    net_files.write_nets(*nets(spark, sf), path)
    return net_files.parse_nets(_in_order(spark, path))[1]


@register("surface_file_after_original", with_sql(POINTS_SQL, __import__("arborlake.catalog.q_surfaces", fromlist=["NET_SQL"]).NET_SQL, body="""
SELECT surface, CAST(max(row) AS INTEGER) AS m, CAST(max(col) AS INTEGER) AS n, count(*) AS n_points, round(sum(x), 4) AS x_sum, true AS in_original FROM net GROUP BY 1
UNION ALL SELECT 'grown_C_' || lpad(CAST(qid AS VARCHAR), 7, '0'), 2, 9, 18, round(9 * (x + x + 1), 4), false FROM pt"""))
def after_original(spark, sf):
    """Nets of one table, and behind them tubes of another, as one file that is read again."""
    from arborlake.sources.lines import numbered

    first, both = fresh(spark, "original"), fresh(spark, "grown")
    net_files.write_nets(*nets(spark, sf), first)
    tubes = points(spark, sf).select(F.lit("C").alias("tree"), F.col("qid").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"),
                                     (F.col("x") + 1).alias("dx"), F.col("y").alias("dy"), F.col("z").alias("dz"), F.lit(0.5).alias("radius_mm"))
    net_files.write_nets(*N.tube_nets(tubes), both, original=first)
    lines = _in_order(spark, both)
    surfaces, _, pts = net_files.parse_nets(lines)
    size = numbered(spark, first).select(F.count("*")).scalar()
    placed = lines.join(surfaces.select(F.col("surface").alias("value")), "value").groupBy(F.col("value").alias("surface")).agg((F.min("pos") <= size).alias("in_original"))
    sums = pts.groupBy("surface").agg(F.count("*").alias("n_points"), F.round(F.sum("x"), 4).alias("x_sum"))
    return surfaces.join(sums, "surface").join(placed, "surface").select("surface", "m", "n", "n_points", "x_sum", "in_original")


@register("segment_tube_nets", with_sql(FOREST_SQL, body="SELECT 'grown_' || tree || '_' || lpad(CAST(id AS VARCHAR), 7, '0') AS surface, 2 AS m, 9 AS n, 18 AS n_points, round(length_mm, 5) AS along FROM seg WHERE length_mm > 0"))
def tube_nets(spark, sf):
    s, _, p = N.tube_nets(forest(spark, sf).where("length_mm > 0"))
    first = p.where("col = 1").groupBy("surface").agg(*[(F.max_by(a, "row") - F.min_by(a, "row")).alias(a) for a in "xyz"])
    size = p.groupBy("surface").agg(F.count("*").cast("int").alias("n_points"))
    return s.join(size, "surface").join(first, "surface").select("surface", "m", "n", "n_points", F.round(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), 5).alias("along"))


@register("material_table_long", """SELECT p_partkey AS label, z, f AS fraction FROM (SELECT p_partkey, 1 AS z, (p_size % 4) / 10.0 AS f FROM part UNION ALL SELECT p_partkey, 8, (p_size % 3) / 10.0 FROM part
 UNION ALL SELECT p_partkey, 53, (p_size % 5 - 2) / 10.0 FROM part) WHERE f > 0""")
def materials(spark, sf):
    wide = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("density"), ((F.col("p_size") % 4) / 10.0).alias("h"),
                                           ((F.col("p_size") % 3) / 10.0).alias("o"), ((F.col("p_size") % 5 - 2) / 10.0).alias("i"))
    return S.material_table(wide, "p_partkey", "p_name", "density", {"h": 1, "o": 8, "i": 53})[1]


@register("run_snapshot_manifest", with_sql(FOREST_SQL, body="""
SELECT '20240102T030405' AS run, sum(n) AS segments, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS lad, 3 AS n_times, (SELECT count(*) FROM orders) AS active_voxels FROM (SELECT count(*) AS n FROM seg)"""))
def snapshot(spark, sf):
    path = fresh(spark, "run")
    segs = forest(spark, sf)
    series = segs.select("tree", "id", F.explode(F.array(*[F.struct(F.lit(i).alias("t_idx"), F.lit(i * 0.5).alias("t")) for i in range(3)])).alias("s")).select("tree", "id", "s.*").withColumn("value", F.col("t") * F.col("id"))
    voxels = table(spark, sf, "orders").select((F.col("o_orderkey") % 25 + 1).alias("i"), F.lit(1).alias("j"), F.col("o_orderkey").alias("k"))
    runs.write_snapshot(path, F.lit("2024-01-02 03:04:05").cast("timestamp"), segs, series, voxels)
    stored = spark.read.schema("tree string, id bigint, run_ts string").parquet(f"{path}/segments")
    doc = spark.read.text(f"{path}/manifest").select(F.from_json("value", "trees array<struct<tree:string,segments:bigint>>, segments bigint, n_times bigint, active_voxels bigint").alias("d"))
    lad = F.filter("d.trees", lambda t: t["tree"] == "LAD")[0]["segments"]
    return doc.select(F.lit(stored.select("run_ts").first()[0]).alias("run"), F.col("d.segments").alias("segments"), lad.alias("lad"), F.col("d.n_times").cast("int").alias("n_times"), F.col("d.active_voxels").alias("active_voxels"))


ORACLE["run_snapshot_manifest"] = ORACLE["run_snapshot_manifest"].replace("sum(n) AS segments", "CAST(sum(n) AS BIGINT) AS segments")


@register("time_frame_manifest", """SELECT o_orderstatus AS frame, count(*) AS overlay_voxels, count(DISTINCT o_orderpriority) AS n_materials, min(replace(o_orderpriority || ',a', ',', '_')) AS first_name FROM orders GROUP BY 1""")
def frames(spark, sf):
    o = table(spark, sf, "orders")
    path = fresh(spark, "frames")
    names = o.groupBy(F.col("o_orderstatus").alias("frame"), F.concat("o_orderpriority", F.lit(",a")).alias("name")).agg(F.count("*").alias("n"))
    mats = names.select("frame", F.ascii("name").alias("label"), "name", (F.col("n") / 100).alias("density"))
    fr = o.groupBy(F.col("o_orderstatus").alias("frame")).agg(F.count("*").alias("overlay_voxels")).withColumns({"time_s": F.ascii("frame") * 0.1, "dynamic_labels": F.lit(2)})
    runs.write_frames(path, fr, o.select(F.col("o_orderstatus").alias("frame"), F.col("o_orderkey").alias("i")), mats)
    doc = spark.read.text(f"{path}/manifest").select(F.from_json("value", "frame string, overlay_voxels bigint, materials array<struct<label:int,name:string>>").alias("d"))
    return doc.select("d.frame", "d.overlay_voxels", F.size("d.materials").cast("bigint").alias("n_materials"), F.array_min(F.col("d.materials.name")).alias("first_name"))


@register("manifest_driven_frames", """SELECT event_type AS scan_path, round(avg(value), 6) AS time_s, count(*) AS overlay_voxels FROM events GROUP BY 1""")
def manifest_frames(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("time_s"), F.count("*").alias("n"))
    entry = F.struct("time_s", F.concat(F.lit("raw/"), F.col("event_type")).alias("raw_path"), F.col("event_type").alias("scan_path"), F.col("n").alias("overlay_voxels"), F.lit(1).cast("bigint").alias("dynamic_labels"))
    doc = e.agg(F.to_json(F.struct(F.collect_list(entry).alias("frames"))).alias("value"))
    path = fresh(spark, "manifest")
    doc.coalesce(1).write.text(path)
    return runs.read_frames(spark, path).select("scan_path", F.round("time_s", 6).alias("time_s"), "overlay_voxels")


@register("preferred_scan_values", """SELECT event_id, CASE WHEN event_type = 'click' THEN value * 2 ELSE value END AS value, CASE WHEN event_type = 'click' THEN 'hu' ELSE 'mu' END AS unit FROM events""")
def preferred(spark, sf):
    e = table(spark, sf, "events").withColumns({"hu": F.when(F.col("event_type") == "click", F.col("value") * 2), "mu": F.col("value")})
    return runs.preferred_values(e.drop("value")).select("event_id", "value", "unit")
