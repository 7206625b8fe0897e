"""Registered queries: voxel operators."""

import uuid

from pyspark.sql import functions as F

from arborlake.catalog.bed import TWIGS_SQL, sig, sig_sql, table, twigs, with_sql
from arborlake.catalog.q_spatial import dist_sql
from arborlake.operators import voxels as V

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


GRID = V.Grid((-2.0, -2.0, -2.0), (2.0, 2.0, 2.0), (55, 55, 55))
WIDE = 30.0


def tubes(spark, sf):
    return twigs(spark, sf).withColumn("radius_mm", F.col("radius_mm") * WIDE)


def hits(spark, sf):
    return V.segment_hits(tubes(spark, sf), GRID, 2)


TUBE_SQL = f"tube AS (SELECT tree, id, px, py, pz, dx, dy, dz, radius_mm * {WIDE} AS radius_mm FROM twig)"


def _range(a):
    lo = f"CAST(least(greatest(floor((least(p{a},d{a}) - radius_mm + 2.0)/2.0) + 1, 1), 55) AS BIGINT)"
    hi = f"CAST(least(greatest(ceil((greatest(p{a},d{a}) + radius_mm + 2.0)/2.0), 1), 55) AS BIGINT)"
    return f"unnest(range({lo}, greatest({lo}, {hi}) + 1))"


HIT_SQL = f"""
hi AS (SELECT *, {_range('x')} AS i FROM tube), hj AS (SELECT *, {_range('y')} AS j FROM hi), hk AS (SELECT *, {_range('z')} AS k FROM hj),
sub AS (SELECT k.*, -2.0 + (i - 1 + (s % 2 + 0.5) / 2) * 2.0 AS x, -2.0 + (j - 1 + (s // 2 % 2 + 0.5) / 2) * 2.0 AS y, -2.0 + (k - 1 + (s // 4 + 0.5) / 2) * 2.0 AS z
  FROM hk k, range(0, 8) r(s)),
hit AS (SELECT tree, id, i, j, k, count(*) FILTER ({dist_sql(s='s', qa='s')} <= radius_mm) / 8 AS share FROM sub s GROUP BY ALL),
hits AS (SELECT * FROM hit WHERE share > 0)"""
VOX = with_sql(TWIGS_SQL, TUBE_SQL, HIT_SQL, body="")


def vox_sql(*ctes, body):
    return with_sql(TWIGS_SQL, TUBE_SQL, HIT_SQL, *ctes, body=body)


@register("segment_voxel_shares", vox_sql(body=f"SELECT tree, id, CAST(i + (j-1)*55 + (k-1)*3025 AS BIGINT) AS voxel, share FROM hits"))
def voxel_shares(spark, sf):
    h = hits(spark, sf)
    return h.select("tree", "id", GRID.linear(F.col("i"), F.col("j"), F.col("k")).cast("bigint").alias("voxel"), "share")


VALUE = "((id * 13 + t_idx * 7) % 50) / 10.0"
FRAMES_SQL = f"vs AS (SELECT tree, id, t_idx, {VALUE} AS value FROM tube, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS t_idx) f)"


def frame_series(spark, sf):
    s = tubes(spark, sf).select("tree", "id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("t_idx"))
    return s.withColumn("value", ((F.col("id") * 13 + F.col("t_idx") * 7) % 50) / 10.0)


@register("voxel_occupancy_and_mean", vox_sql(FRAMES_SQL, body="""
SELECT i, j, k, t_idx, round(sum(share), 6) AS occupancy, round(sum(share*value)/sum(share), 6) AS value FROM hits h JOIN vs ON vs.tree = h.tree AND vs.id = h.id GROUP BY 1, 2, 3, 4"""))
def voxel_means(spark, sf):
    m = V.mean_values(hits(spark, sf), frame_series(spark, sf))
    return m.select(*[F.col(c).cast("bigint").alias(c) for c in V.IJK], "t_idx", F.round("occupancy", 6).alias("occupancy"), F.round("value", 6).alias("value"))


@register("voxel_plain_occupancy", vox_sql(body="SELECT i, j, k, round(sum(share), 6) AS occupancy FROM hits GROUP BY 1, 2, 3"))
def plain_occupancy(spark, sf):
    return V.occupancy(hits(spark, sf)).select(*[F.col(c).cast("bigint").alias(c) for c in V.IJK], F.round("occupancy", 6).alias("occupancy"))


COVER_SQL = """cov AS (SELECT t_idx, i, j, k, 1 - product(1 - share) AS phi, sum(share*value)/sum(share) AS value FROM hits h JOIN vs ON vs.tree = h.tree AND vs.id = h.id
  GROUP BY 1, 2, 3, 4 HAVING 1 - product(1 - share) >= 1e-4)"""


@register("voxel_union_coverage", vox_sql(FRAMES_SQL, COVER_SQL, body="SELECT t_idx, i, j, k, round(phi, 7) AS phi, round(value, 6) AS value FROM cov"))
def coverage(spark, sf):
    c = V.union_coverage(hits(spark, sf), frame_series(spark, sf))
    return c.select("t_idx", *[F.col(x).cast("bigint").alias(x) for x in V.IJK], F.round("phi", 7).alias("phi"), F.round("value", 6).alias("value"))


def label_volume(spark, sf):
    """Labelled voxels from the order keys: 25 x 25 planes, as many as the table fills."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (key % 25 + 1).cast("int").alias("i"), (F.floor(key / 25) % 25 + 1).cast("int").alias("j"), (F.floor(key / 625) + 1).cast("int").alias("k"),
        (F.floor("o_totalprice") % 5).cast("int").alias("label"), F.col("o_totalprice").alias("price"))


LABEL_SQL = """lab AS (SELECT CAST(o_orderkey % 25 + 1 AS INTEGER) AS i, CAST(o_orderkey // 25 % 25 + 1 AS INTEGER) AS j, CAST(o_orderkey // 625 + 1 AS INTEGER) AS k,
  CAST(floor(o_totalprice) % 5 AS INTEGER) AS label, o_totalprice AS price FROM orders)"""
PHI, CONC = [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0], [0.0, 0.5, 1.0, 2.0, 3.0, 5.0]
BIN_SQL = f"""hosted AS (SELECT c.*, l.label AS host, list_position([abs(phi - b) FOR b IN {PHI}], list_min([abs(phi - b) FOR b IN {PHI}])) AS phi_bin,
  list_position([abs(value - b) FOR b IN {CONC}], list_min([abs(value - b) FOR b IN {CONC}])) AS value_bin FROM (SELECT t_idx, i, j, k, round(phi, 9) AS phi, round(value, 9) AS value FROM cov) c
  JOIN lab l ON l.i = c.i AND l.j = c.j AND l.k = c.k),
cls AS (SELECT DISTINCT t_idx, host, phi_bin, value_bin FROM hosted),
num AS (SELECT *, 4 + row_number() OVER (PARTITION BY t_idx ORDER BY host, phi_bin, value_bin) AS label FROM cls),
chg AS (SELECT h.*, n.label FROM hosted h JOIN num n ON n.t_idx = h.t_idx AND n.host = h.host AND n.phi_bin = h.phi_bin AND n.value_bin = h.value_bin)"""


def changed(spark, sf):
    c = V.union_coverage(hits(spark, sf), frame_series(spark, sf)).withColumns({"phi": F.round("phi", 9), "value": F.round("value", 9)})
    base = label_volume(spark, sf)
    materials = base.select("label").distinct()
    return V.dynamic_classes(c, base.select(*V.IJK, "label"), materials, PHI, CONC)


@register("dynamic_material_classes", vox_sql(FRAMES_SQL, COVER_SQL, LABEL_SQL, BIN_SQL, body="""
SELECT t_idx, i, j, k, host, CAST(phi_bin AS INTEGER) AS phi_bin, CAST(value_bin AS INTEGER) AS value_bin, CAST(label AS INTEGER) AS label FROM chg"""))
def dynamic_classes(spark, sf):
    return changed(spark, sf).select("t_idx", *[F.col(x).cast("bigint").alias(x) for x in V.IJK], "host", "phi_bin", "value_bin", "label")


@register("labelled_time_frames", vox_sql(FRAMES_SQL, COVER_SQL, LABEL_SQL, BIN_SQL, body="""
SELECT f.t_idx, l.i, l.j, l.k, CAST(coalesce(c.label, l.label) AS INTEGER) AS label FROM lab l CROSS JOIN (SELECT DISTINCT t_idx FROM vs) f
LEFT JOIN chg c ON c.t_idx = f.t_idx AND c.i = l.i AND c.j = l.j AND c.k = l.k"""))
def time_frames(spark, sf):
    frames = frame_series(spark, sf).select("t_idx").distinct()
    store = V.store_frames(label_volume(spark, sf).drop("price"), changed(spark, sf))
    return V.read_frames(store, frames).select("t_idx", "i", "j", "k", "label")


@register("label_box", with_sql(LABEL_SQL, body="SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(k) AS k0, max(k) AS k1 FROM lab WHERE label IN (2)"))
def label_box(spark, sf):
    return V.label_box(label_volume(spark, sf), [2])


@register("grid_origin_from_two_labels", with_sql(LABEL_SQL, """
a AS (SELECT (min(i)+max(i))/2 AS ci, (min(j)+max(j))/2 AS cj, (min(k)+max(k))/2 AS ck FROM lab WHERE label = 1),
b AS (SELECT (min(i)+max(i))/2 AS ci, (min(j)+max(j))/2 AS cj, (min(k)+max(k))/2 AS ck FROM lab WHERE label = 2)""", body="""
SELECT ((10 - (a.ci-1)*2.0) + (11 - (b.ci-1)*2.0))/2 AS x0, ((20 - (a.cj-1)*2.0) + (21 - (b.cj-1)*2.0))/2 AS y0, ((30 - (a.ck-1)*3.0) + (31 - (b.ck-1)*3.0))/2 AS z0 FROM a, b"""))
def grid_origin(spark, sf):
    lab = label_volume(spark, sf)
    return V.estimated_origin(V.label_box(lab, [1]), (10.0, 20.0, 30.0), V.label_box(lab, [2]), (11.0, 21.0, 31.0), (2.0, 2.0, 3.0))


@register("raw_label_volume", with_sql(LABEL_SQL, "sz AS (SELECT max(k) AS nk FROM lab)", body="""
SELECT CAST(a.i AS INTEGER) AS i, CAST(26 - b.j AS INTEGER) AS j, CAST(c.k AS INTEGER) AS k, CAST(CASE WHEN a.i = 26 THEN 10 ELSE coalesce(l.label, 9) END AS INTEGER) AS label
FROM range(1, 27) a(i), range(1, 26) b(j), (SELECT unnest(range(1, nk + 1)) AS k FROM sz) c LEFT JOIN lab l ON l.i = a.i AND l.j = b.j AND l.k = c.k"""))
def raw_volume(spark, sf):
    """The label volume as a flat file below the shared folder, read again with the second axis reversed."""
    from arborlake.plans.cut import work_dir
    from arborlake.sources.raw_labels import read_raw_labels, write_raw_labels

    lab = label_volume(spark, sf)
    depth = lab.agg(F.max("k")).first()[0]
    path = f"{work_dir(spark)}/raw-{uuid.uuid4().hex}"
    write_raw_labels(lab.select(*V.IJK, "label"), path, (25, 25, depth), 9)
    part = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").first()[0]
    return read_raw_labels(spark, part, (26, 25, depth), reverse=(2,))


@register("crop_to_labels", with_sql(LABEL_SQL, """
bx AS (SELECT greatest(1, min(i)-2) AS i0, least(25, max(i)+2) AS i1, greatest(1, min(j)-2) AS j0, least(25, max(j)+2) AS j1, greatest(1, min(k)-1) AS k0, max(k)+1 AS k1 FROM lab
  WHERE CASE WHEN i BETWEEN 8 AND 15 AND j BETWEEN 9 AND 14 THEN label ELSE -1 END IN (3))""", body="""
SELECT CAST(i - i0 + 1 AS INTEGER) AS i, CAST(j - j0 + 1 AS INTEGER) AS j, CAST(k - k0 + 1 AS INTEGER) AS k, label FROM (SELECT i, j, k, CASE WHEN i BETWEEN 8 AND 15 AND j BETWEEN 9 AND 14 THEN label ELSE -1 END AS label FROM lab), bx
WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1 AND k BETWEEN k0 AND k1"""))
def crop(spark, sf):
    lab = label_volume(spark, sf)
    inner = F.col("i").between(8, 15) & F.col("j").between(9, 14)
    lab = lab.withColumn("label", F.when(inner, F.col("label")).otherwise(F.lit(-1))).drop("price")
    depth = lab.agg(F.max("k")).first()[0]
    return V.crop_to_labels(lab, [3], (1.0, 1.0, 2.0), 2.0, (25, 25, depth))[0].select("i", "j", "k", "label")


@register("nearest_neighbour_downsample", with_sql(LABEL_SQL, "sz AS (SELECT max(k) AS nk FROM lab)", body="""
SELECT (i-1-1)//3 + 1 AS i, (j-1-1)//3 + 1 AS j, (k-1-1)//3 + 1 AS k, label FROM lab, sz WHERE (i-2) % 3 = 0 AND (j-2) % 3 = 0 AND (k-2) % 3 = 0 AND i >= 2 AND j >= 2 AND k >= 2
 AND (i-2)//3 < 8 AND (j-2)//3 < 8 AND (k-2)//3 < nk//3"""))
def downsample(spark, sf):
    lab = label_volume(spark, sf).drop("price")
    depth = lab.agg(F.max("k")).first()[0]
    return V.downsample(lab, (25, 25, depth), 3).select("i", "j", "k", "label")


@register("sparse_to_dense", with_sql(LABEL_SQL, """
sp AS (SELECT i, j, k, 0 AS t_idx, price AS value FROM lab WHERE label = 1 UNION ALL SELECT i, j, k, 1, price / 2 FROM lab WHERE label = 2), sz AS (SELECT max(k) AS nk FROM lab)""", body="""
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, CAST(c.k AS INTEGER) AS k, CAST(d.t AS INTEGER) AS t_idx, coalesce(sp.value, 0) AS value
FROM range(1, 26) a(i), range(1, 26) b(j), (SELECT unnest(range(1, nk + 1)) AS k FROM sz) c, range(0, 2) d(t) LEFT JOIN sp ON sp.i = a.i AND sp.j = b.j AND sp.k = c.k AND sp.t_idx = d.t"""))
def dense(spark, sf):
    lab = label_volume(spark, sf)
    sp = lab.where("label = 1").select(*V.IJK, F.lit(0).alias("t_idx"), F.col("price").alias("value")).unionByName(
        lab.where("label = 2").select(*V.IJK, F.lit(1).alias("t_idx"), (F.col("price") / 2).alias("value")))
    depth = lab.agg(F.max("k")).first()[0]
    return V.to_dense(sp, (25, 25, depth), 2)


@register("region_of_interest_mean", with_sql(LABEL_SQL, "sz AS (SELECT max(k) AS nk FROM lab)", body=f"""
SELECT {sig_sql('avg(price)')} AS mean, count(*) AS n FROM lab, sz WHERE pow(i-12, 2) + pow(j-12, 2) <= 4 AND k BETWEEN greatest(1, nk//4) AND least(nk, 3*nk//4)"""))
def roi(spark, sf):
    lab = label_volume(spark, sf).withColumn("value", F.col("price"))
    depth = lab.agg(F.max("k")).first()[0]
    return V.roi_mean(lab, (25, 25, depth)).select(sig(F.col("mean")).alias("mean"), "n")


@register("pixel_slice_table", with_sql(LABEL_SQL, body="""
SELECT k, CAST(min(least(greatest(round_even(price/3 - 60000, 0), -32768), 32767)) AS INTEGER) AS pixel_min, CAST(max(least(greatest(round_even(price/3 - 60000, 0), -32768), 32767)) AS INTEGER) AS pixel_max,
 CAST(-5.0 + (k-1)*2.5 AS DOUBLE) AS z FROM lab GROUP BY k"""))
def slices(spark, sf):
    lab = label_volume(spark, sf).withColumn("value", F.col("price") / 3 - 60000)
    return V.slice_table(lab, [], -5.0, 2.5)


@register("display_range", with_sql(LABEL_SQL, """rk AS (SELECT label, price, row_number() OVER (PARTITION BY label ORDER BY price) AS r, count(*) OVER (PARTITION BY label) AS n FROM lab)""", body="""
SELECT label, min(price) FILTER (r = CAST(round_even(1 + 0.01*(n-1), 0) AS BIGINT)) AS low, min(price) FILTER (r = CAST(round_even(1 + 0.995*(n-1), 0) AS BIGINT)) AS high FROM rk GROUP BY 1"""))
def display_range(spark, sf):
    return V.display_range(label_volume(spark, sf).select("label", F.col("price").alias("value")), ["label"]).select("label", "low", "high")


@register("voxel_components")
def voxel_components(spark, sf):
    cells = label_volume(spark, sf).select(*V.IJK, (F.col("label") % 2).alias("owner"))
    return V.components(cells).groupBy("owner", "component").agg(F.count("*").alias("n"))


@register("voxel_island_clean_up")
def islands(spark, sf):
    cells = label_volume(spark, sf).select(*V.IJK, (F.col("label") % 3).alias("owner"))
    return V.clean_islands(cells).select(*V.IJK, "owner")


COMP_SQL = """raw AS (SELECT p_partkey % 12 AS label, [1,6,7,8,20,53][p_partkey % 6 + 1] AS z, p_size + 1 AS w FROM part),
cmp AS (SELECT label, z, sum(w) / sum(sum(w)) OVER (PARTITION BY label) AS fraction, 1.0 + label / 10.0 AS density FROM raw GROUP BY 1, 2),
am(z, a, ev) AS (VALUES (1, 1.008, 19.2), (6, 12.011, 81.0), (7, 14.007, 82.0), (8, 15.999, 95.0), (20, 40.078, 191.0), (53, 126.904, 491.0))"""


def compositions(spark, sf):
    z = F.element_at(F.array(*[F.lit(v) for v in (1, 6, 7, 8, 20, 53)]), (F.col("p_partkey") % 6 + 1).cast("int"))
    raw = table(spark, sf, "part").groupBy((F.col("p_partkey") % 12).alias("label"), z.alias("z")).agg(F.sum(F.col("p_size") + 1).alias("w"))
    total = raw.groupBy("label").agg(F.sum("w").alias("all"))
    return raw.join(total, "label").select("label", "z", (F.col("w") / F.col("all")).alias("fraction"), (1.0 + F.col("label") / 10.0).alias("density"))


MIX_SQL = """el AS (SELECT label, sum(fraction*c.z/a)/sum(fraction/a) AS za, exp(sum(fraction*c.z/a*ln(ev))/sum(fraction*c.z/a)) AS ev, any_value(density) AS density FROM cmp c JOIN am ON am.z = c.z GROUP BY 1),
prt AS (SELECT m.mix, l.label, CASE WHEN l.label = m.mix THEN 0.6 ELSE 0.4 END AS v FROM range(0, 11) m(mix), range(0, 12) l(label) WHERE l.label IN (m.mix, m.mix + 1)),
wt AS (SELECT mix, p.label, v*density/sum(v*density) OVER (PARTITION BY mix) AS w, el.* FROM prt p JOIN el ON el.label = p.label)"""


def mix_parts(spark, sf):
    have = table(spark, sf, "part").select((F.col("p_partkey") % 12).alias("label")).distinct()
    a = have.where("label < 11").select(F.col("label").alias("mix"), "label", F.lit(0.6).alias("volume"))
    return a.unionByName(have.where("label > 0").select((F.col("label") - 1).alias("mix"), "label", F.lit(0.4).alias("volume")))


@register("mixture_density_and_averages", with_sql(COMP_SQL, MIX_SQL, body="""
SELECT mix, round(sum(w*density), 8) AS density, round(sum(w*za), 8) AS z_per_a, round(sum(w*ev), 6) AS excitation_ev FROM wt GROUP BY 1"""))
def mixture_density(spark, sf):
    _, d = V.mixture(mix_parts(spark, sf), compositions(spark, sf), ["mix"])
    return d.select("mix", F.round("density", 8).alias("density"), F.round("z_per_a", 8).alias("z_per_a"), F.round("excitation_ev", 6).alias("excitation_ev"))


@register("mixture_composition", with_sql(COMP_SQL, MIX_SQL, body="SELECT mix, z, round(sum(w*fraction), 9) AS fraction FROM wt JOIN cmp c ON c.label = wt.label GROUP BY 1, 2"))
def mixture_elements(spark, sf):
    e, _ = V.mixture(mix_parts(spark, sf), compositions(spark, sf), ["mix"])
    return e.select("mix", "z", F.round("fraction", 9).alias("fraction"))


@register("iodine_in_composition", with_sql(COMP_SQL, """
io AS (SELECT label, z, fraction, density, label * 2.0 / 1000 AS c FROM cmp),
al AS (SELECT label, z, fraction * (1 - c/(density+c)) AS f, density + c AS density FROM io UNION ALL SELECT DISTINCT label, 53, c/(density+c), density + c FROM io)""", body="""
SELECT label, z, round(sum(f), 9) AS fraction, round(any_value(density), 9) AS density FROM al GROUP BY 1, 2"""))
def iodine(spark, sf):
    out = V.with_iodine(compositions(spark, sf), F.col("label") * 2.0)
    return out.select("label", "z", F.round("fraction", 9).alias("fraction"), F.round("density", 9).alias("density"))
