"""Registered queries: windows, time series, ranking and set operations."""

from pyspark.sql import functions as F

from arborlake.catalog.bed import FOREST_SQL, LINES_SQL, forest, lines, sig, sig_sql, table, with_sql
from arborlake.catalog.q_trees import DEPTH_SQL
from arborlake.functions import flow
from arborlake.functions.vectors import triple
from arborlake.operators import lines as L, ranking, series as S, trees
from arborlake.plans.cut import cut

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


ARC = """st AS (SELECT *, coalesce(sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)+pow(z-lag(z) OVER w,2)), 0) AS step FROM ln WINDOW w AS (PARTITION BY line ORDER BY pos)),
arc AS (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY pos) AS s FROM st)"""


def written_lines(spark, sf, *columns):
    """Points of the lines numbered once, where a query goes over them several times."""
    return cut(lines(spark, sf).select("line", "pos", *columns), "lines")


@register("line_arc_length", with_sql(LINES_SQL, ARC, body="SELECT line, pos, round(step, 6) AS step, round(s, 6) AS s FROM arc"))
def arc_length(spark, sf):
    return L.arc_length(lines(spark, sf)).select("line", F.col("pos").cast("bigint").alias("pos"), F.round("step", 6).alias("step"), F.round("s", 6).alias("s"))


@register("line_summary", with_sql(LINES_SQL, ARC, body="""
SELECT line, count(*) AS n, min(radius_mm) AS r_min, max(radius_mm) AS r_max, round(avg(radius_mm), 7) AS r_mean, round(max(s), 6) AS length_mm,
 arg_min(x, pos) AS first_x, arg_max(x, pos) AS last_x FROM arc GROUP BY 1"""))
def line_summary(spark, sf):
    return L.line_summary(lines(spark, sf)).select("line", "n", "r_min", "r_max", F.round("r_mean", 7).alias("r_mean"), F.round("length_mm", 6).alias("length_mm"),
                                                   F.col("first.x").alias("first_x"), F.col("last.x").alias("last_x"))


@register("line_slice_and_reverse", with_sql(LINES_SQL, "sz AS (SELECT line, max(pos) AS n FROM ln GROUP BY 1)", body="""
SELECT l.line, 'sliced' AS kind, l.pos - least(3, n) + 1 AS pos, x FROM ln l JOIN sz ON sz.line = l.line WHERE pos >= least(3, n)
UNION ALL SELECT l.line, 'reversed', n + 1 - l.pos, x FROM ln l JOIN sz ON sz.line = l.line"""))
def slice_reverse(spark, sf):
    pts = written_lines(spark, sf, "x")
    a = L.slice_from(pts, F.lit(3)).select("line", F.lit("sliced").alias("kind"), F.col("pos").cast("bigint").alias("pos"), "x")
    return a.unionByName(L.reversed_lines(pts).select("line", F.lit("reversed").alias("kind"), F.col("pos").cast("bigint").alias("pos"), "x"))


@register("line_chained_segments", with_sql(LINES_SQL, """
nx AS (SELECT line, pos, x, radius_mm, lead(x) OVER w AS dx, lead(radius_mm) OVER w AS nr FROM ln WINDOW w AS (PARTITION BY line ORDER BY pos))""", body="""
SELECT line, pos AS id, CASE WHEN pos > 1 THEN pos - 1 ELSE -1 END AS parent_id, x AS px, dx, round((radius_mm + nr) / 2, 9) AS radius_mm FROM nx WHERE dx IS NOT NULL"""))
def chained(spark, sf):
    return L.chained_segments(lines(spark, sf)).select("line", F.col("id").cast("bigint").alias("id"), F.col("parent_id").cast("bigint").alias("parent_id"),
                                                       "px", "dx", F.round("radius_mm", 9).alias("radius_mm"))


@register("line_resampled")
def resampled(spark, sf):
    return L.resample(written_lines(spark, sf, *L.POINT)).select("line", "pos", *[F.round(c, 6).alias(c) for c in L.POINT])


@register("line_chain_merge", with_sql(LINES_SQL, """
ch AS (SELECT *, line // 5 AS chain, line % 5 AS rank FROM ln),
se AS (SELECT chain, rank, max(pos) AS n, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_min(z, pos) AS az, arg_max(x, pos) AS bx, arg_max(y, pos) AS by_, arg_max(z, pos) AS bz FROM ch GROUP BY 1, 2),
sd AS (SELECT *, CASE WHEN sqrt(pow(ax-lag(bx) OVER w,2)+pow(ay-lag(by_) OVER w,2)+pow(az-lag(bz) OVER w,2)) <= 4 THEN 1 ELSE 0 END AS d FROM se WINDOW w AS (PARTITION BY chain ORDER BY rank)),
so AS (SELECT *, coalesce(sum(n - d) OVER (PARTITION BY chain ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sd)""", body="""
SELECT c.chain, CAST(b + pos - d AS BIGINT) AS chain_pos, c.line, c.pos FROM ch c JOIN so ON so.chain = c.chain AND so.rank = c.rank WHERE pos > d"""))
def chain_merge(spark, sf):
    pts = lines(spark, sf).withColumns({"chain": F.floor(F.col("line") / 5), "rank": F.col("line") % 5})
    return L.merge_chain(pts, 4.0).select("chain", "chain_pos", "line", F.col("pos").cast("bigint").alias("pos"))


JOINT_SQL = """
cn AS (SELECT DISTINCT line AS child, line // 2 AS parent FROM ln WHERE line > 0 AND line // 2 IN (SELECT line FROM ln)),
bp AS (SELECT cn.parent, cn.child, min({'d2': pow(p.x-c.x,2)+pow(p.y-c.y,2)+pow(p.z-c.z,2), 'pi': p.pos, 'ci': c.pos}) AS m FROM cn JOIN ln p ON p.line = cn.parent JOIN ln c ON c.line = cn.child GROUP BY 1, 2),
nd AS (SELECT line, max(pos) AS n, arg_max(x, pos) AS x, arg_max(y, pos) AS y, arg_max(z, pos) AS z FROM ln GROUP BY 1),
ep AS (SELECT cn.parent, cn.child, any_value(e.n) AS n, min({'d2': pow(e.x-c.x,2)+pow(e.y-c.y,2)+pow(e.z-c.z,2), 'ci': c.pos}) AS e FROM cn JOIN nd e ON e.line = cn.parent JOIN ln c ON c.line = cn.child GROUP BY 1, 2),
jj AS (SELECT b.parent, b.child, n, m, e, n - m.pi <= 2 AND sqrt(e.d2) <= sqrt(m.d2) + 1.0 AS snap FROM bp b JOIN ep ON ep.parent = b.parent AND ep.child = b.child)"""


@register("line_joints", with_sql(LINES_SQL, JOINT_SQL, body="""
SELECT parent, child, CASE WHEN snap THEN n ELSE m.pi END AS parent_index, CASE WHEN snap THEN e.ci ELSE m.ci END AS child_index, round(sqrt(CASE WHEN snap THEN e.d2 ELSE m.d2 END), 6) AS gap_mm FROM jj"""))
def joints(spark, sf):
    out = joined_lines(written_lines(spark, sf, *L.POINT))
    return out.select("parent", "child", F.col("parent_index").cast("bigint").alias("parent_index"), F.col("child_index").cast("bigint").alias("child_index"), F.round("gap_mm", 6).alias("gap_mm"))


def joined_lines(pts):
    """Every line hangs on the one with half its number."""
    have = pts.select("line").distinct()
    conn = have.where("line > 0").select(F.col("line").alias("child"), F.floor(F.col("line") / 2).alias("parent"))
    return L.joints(pts, conn.join(have.withColumnRenamed("line", "parent"), "parent", "left_semi"))


@register("line_tree_summary", with_sql(LINES_SQL, JOINT_SQL, """
gp AS (SELECT child % 7 AS tree, max(sqrt(CASE WHEN snap THEN e.d2 ELSE m.d2 END)) AS gap FROM jj GROUP BY 1)""", body="""
SELECT l.line % 7 AS tree, count(DISTINCT l.line) AS n_lines, count(*) AS n_points, round(avg(radius_mm), 7) AS r_mean, round(coalesce(any_value(gap), 0), 6) AS max_gap_mm
FROM ln l LEFT JOIN gp ON gp.tree = l.line % 7 GROUP BY 1"""))
def tree_summary(spark, sf):
    pts = written_lines(spark, sf, *L.POINT)
    owned = pts.select((F.col("line") % 7).alias("tree"), "line").distinct()
    out = L.tree_summary(pts, owned, joined_lines(pts).withColumn("tree", F.col("child") % 7))
    return out.select("tree", "n_lines", "n_points", F.round("r_mean", 7).alias("r_mean"), F.round("max_gap_mm", 6).alias("max_gap_mm"))


T = 41
TIMES = "tm AS (SELECT CAST(i AS INTEGER) AS t_idx, i * 0.1 AS t FROM range(0, 41) r(i))"
VAL = "(radius_mm * 1000) * (CASE WHEN t > 0.25 THEN pow((t-0.25)/0.75, 3.0) * exp(3.0*(1-(t-0.25)/0.75)) ELSE 0 END)"
SERIES = f"ser AS (SELECT tree, id, t_idx, CAST(t AS DOUBLE) AS t, length_mm, radius_mm, {VAL} AS value FROM seg, (SELECT t_idx, CAST(t AS DOUBLE) AS t FROM tm) x)"


def long_series(spark, sf):
    s = S.time_table(forest(spark, sf).select("tree", "id", "radius_mm", "length_mm"), T, 0.0, 0.1)
    return s.withColumn("value", F.col("radius_mm") * 1000 * flow.gamma_variate(F.col("t"), 1.0, 0.25, 1.0, 3.0))


@register("input_curves", with_sql(FOREST_SQL, TIMES, SERIES, body=f"""
SELECT tree, id, t_idx, {sig_sql('value')} AS value, CASE WHEN t <= 0.5 + radius_mm * 0 THEN 10.0 ELSE 0 END::DOUBLE AS pulse FROM ser"""))
def input_curves(spark, sf):
    return long_series(spark, sf).select("tree", "id", "t_idx", sig(F.col("value")).alias("value"), flow.pulse(F.col("t"), 10.0, 0.0, 0.5).alias("pulse"))


@register("uniform_step_check", with_sql(FOREST_SQL, TIMES, SERIES, """
lg AS (SELECT tree, id, t_idx, CASE WHEN id % 10 = 0 AND t_idx = 20 THEN t + 0.01 ELSE t END AS t FROM ser),
sp AS (SELECT *, t - lag(t) OVER (PARTITION BY tree, id ORDER BY t_idx) AS st FROM lg)""", body="""
SELECT tree, id, count(*) AS n, round(max(st) FILTER (t_idx = 1), 9) AS dt, min(st) > 0 AND max(abs(st - 0.1)) < 1e-8 AS uniform FROM sp GROUP BY 1, 2"""))
def uniform(spark, sf):
    s = long_series(spark, sf).withColumn("t", F.when((F.col("id") % 10 == 0) & (F.col("t_idx") == 20), F.col("t") + 0.01).otherwise(F.col("t")))
    return S.uniform_step(s, ["tree", "id"], rtol=1e-7).select("tree", "id", "n", F.round("dt", 9).alias("dt"), "uniform")


@register("bounded_running_sum", with_sql(FOREST_SQL, TIMES, SERIES, """
rt AS (SELECT tree, id, t_idx, value * cos(t * 5 + id % 7) AS rate FROM ser),
run AS (SELECT tree, id, t_idx, rate, CAST(0 AS DOUBLE) AS c FROM rt WHERE t_idx = 0 UNION ALL
  SELECT r.tree, r.id, n.t_idx, n.rate, greatest(r.c + 0.1 * r.rate, 0) FROM run r JOIN rt n ON n.tree = r.tree AND n.id = r.id AND n.t_idx = r.t_idx + 1)""", recursive=True,
 body="SELECT tree, id, t_idx, round(c, 7) AS bounded FROM run"))
def bounded(spark, sf):
    rate = F.col("value") * F.cos(F.col("t") * 5 + F.col("id") % 7)
    return S.bounded_running_sum(long_series(spark, sf), ["tree", "id"], rate, 0.1).select("tree", "id", "t_idx", (F.round("bounded", 7) + 0.0).alias("bounded"))


@register("delayed_history", with_sql(FOREST_SQL, TIMES, SERIES, """
hs AS (SELECT tree, id, list(value ORDER BY t_idx) AS v FROM ser GROUP BY 1, 2),
ps AS (SELECT hs.tree, hs.id, t_idx, v, (t - (0.013 + (id % 11) * 0.07) - 0.0) / 0.1 AS p FROM hs, (SELECT t_idx, CAST(t AS DOUBLE) AS t FROM tm) x),
ix AS (SELECT *, CAST(floor(p) AS INTEGER) AS lo, least(CAST(ceil(p) AS INTEGER), t_idx) AS hi FROM ps)""", body=f"""
SELECT tree, id, t_idx, {sig_sql('CASE WHEN p < 0 THEN 0 ELSE (1-(p-floor(p)))*v[lo+1] + (p-floor(p))*v[hi+1] END', 6)} AS delayed FROM ix"""))
def delayed(spark, sf):
    d = S.delayed(long_series(spark, sf).select("tree", "id", "t_idx", "t", "value"), ["tree", "id"], 0.013 + (F.col("id") % 11) * 0.07, 0.0, 0.1)
    return d.select("tree", "id", "t_idx", sig(F.col("delayed"), 6).alias("delayed"))


@register("series_summaries", with_sql(FOREST_SQL, TIMES, SERIES, body=f"""
SELECT tree, id, {sig_sql('max(value)')} AS peak, round(arg_max(t, (value, -t)), 6) AS peak_t, coalesce(round(min(t) FILTER (value > 20), 6), 1e308) AS first_t,
 count(*) FILTER (value > 20) AS n_above FROM ser GROUP BY 1, 2"""))
def summaries(spark, sf):
    s = S.summary(long_series(spark, sf), ["tree", "id"], 20.0)
    return s.select("tree", "id", sig(F.col("peak")).alias("peak"), F.round("peak_t", 6).alias("peak_t"),
                    F.when(F.col("first_t") == float("inf"), F.lit(1e308)).otherwise(F.round("first_t", 6)).alias("first_t"), "n_above")


@register("never_above_and_quantiles", with_sql(FOREST_SQL, TIMES, SERIES, """pk AS (SELECT tree, id, max(value) AS peak FROM ser GROUP BY 1, 2)""", body=f"""
SELECT tree, count(*) FILTER (peak <= 20) AS never_above, {sig_sql('quantile_disc(peak, 0.5)')} AS q50, {sig_sql('quantile_disc(peak, 0.9)')} AS q90,
 {sig_sql('quantile_disc(peak, 0.99)')} AS q99 FROM pk GROUP BY 1"""))
def quantiles(spark, sf):
    from arborlake.plans.running import order_statistic

    peaks = long_series(spark, sf).groupBy("tree", "id").agg(F.max("value").alias("peak"))
    never = peaks.groupBy("tree").agg(F.count_if(F.col("peak") <= 20).alias("never_above"))
    qs = order_statistic(peaks.drop("id"), ["tree"], "peak", {f"q{int(q * 100)}": F.greatest(F.ceil(F.lit(q).cast("decimal(4,2)") * F.col("total")), F.lit(1)) for q in (0.5, 0.9, 0.99)})
    return never.join(qs, "tree").select("tree", "never_above", *[sig(F.col(c)).alias(c) for c in ("q50", "q90", "q99")])


@register("segment_mass", with_sql(FOREST_SQL, TIMES, SERIES, body=f"""
SELECT tree, id, t_idx, {sig_sql('value * pi()*radius_mm*radius_mm*length_mm/1000', 8)} AS mass_mg FROM ser"""))
def mass(spark, sf):
    vol = forest(spark, sf).select("tree", "id", flow.volume_ml(F.col("length_mm"), F.col("radius_mm")).alias("volume_ml"))
    return S.segment_mass(long_series(spark, sf).select("tree", "id", "t_idx", "value"), vol).select("tree", "id", "t_idx", sig(F.col("mass_mg"), 8).alias("mass_mg"))


def _hist(lst, pos, n):
    return (f"CASE WHEN {pos} < 0 THEN 0.0 WHEN ceil({pos}) > {n} THEN {lst}[{n}+1] ELSE (1-({pos}-floor({pos})))*{lst}[CAST(floor({pos}) AS INTEGER)+1]"
            f" + ({pos}-floor({pos}))*{lst}[CAST(ceil({pos}) AS INTEGER)+1] END")


@register("delay_propagation", with_sql(FOREST_SQL, DEPTH_SQL, f"""
tau AS (SELECT d.tree, d.id, d.parent_id, d.depth, 0.05 + s.length_mm / 300 AS tau FROM dep d JOIN seg s ON s.tree = d.tree AND s.id = d.id),
rc AS (SELECT [CASE WHEN i*0.1 <= 1.0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(0, 41)] AS c),
wave AS (SELECT t.tree, t.id, t.tau, rc.c AS inl, [{_hist('rc.c', '(i - t.tau/0.1)', 'i')} FOR i IN range(0, 41)] AS outl FROM tau t, rc WHERE depth = 0
  UNION ALL SELECT t.tree, t.id, t.tau, w.outl, [{_hist('w.outl', '(i - t.tau/0.1)', 'i')} FOR i IN range(0, 41)] FROM wave w JOIN tau t ON t.tree = w.tree AND t.parent_id = w.id),
fl AS (SELECT tree, id, tau, unnest(range(0, 41)) AS t_idx, unnest(inl) AS a, unnest(outl) AS b FROM wave),
sm AS (SELECT tree, id, t_idx, b, coalesce(sum(0.1 * (a - b) / tau) OVER (PARTITION BY tree, id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM fl),
cl AS (SELECT *, s - min(s) OVER (PARTITION BY tree, id ORDER BY t_idx) AS c FROM sm)""", recursive=True, body="""
SELECT tree, id, CAST(t_idx AS INTEGER) AS t_idx, round(b, 6) AS outlet, round(c, 5) AS content FROM cl"""))
def propagation(spark, sf):
    segs = forest(spark, sf)
    curve = F.transform(F.sequence(F.lit(0), F.lit(T - 1)), lambda i: F.when(i * 0.1 <= 1.0, F.lit(10.0)).otherwise(F.lit(0.0)))
    inputs = segs.select("tree").distinct().withColumn("curve", curve)
    wide = S.delay_propagation(segs, 0.05 + F.col("length_mm") / 300, inputs, 0.1)
    long = S.long_form(wide, ["tree", "id"], ["outlet", "content"], 0.0, 0.1)
    return long.select("tree", "id", "t_idx", (F.round("outlet", 6) + 0.0).alias("outlet"), (F.round("content", 5) + 0.0).alias("content"))


ASOF = """ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events),
ask AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'error'), sam AS (SELECT user_id, t, max(value) AS value FROM ev WHERE event_type = 'click' GROUP BY 1, 2),
bk AS (SELECT a.event_id, a.user_id, a.t, s.t AS pt, s.value AS pv FROM ask a ASOF LEFT JOIN sam s ON s.user_id = a.user_id AND s.t <= a.t),
fw AS (SELECT a.event_id, s.t AS nt, s.value AS nv FROM ask a ASOF LEFT JOIN sam s ON s.user_id = a.user_id AND s.t > a.t),
bf AS (SELECT b.*, nt, nv FROM bk b JOIN fw f ON f.event_id = b.event_id)"""


def event_series(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value")
    asked = e.where("event_type = 'error'").select("event_id", "user_id", "t")
    return asked, e.where("event_type = 'click'").groupBy("user_id", "t").agg(F.max("value").alias("value"))


@register("as_of_nearest_sample", with_sql(ASOF, body="""
SELECT event_id, user_id, CASE WHEN nt IS NULL OR (pt IS NOT NULL AND t - pt <= nt - t) THEN pv ELSE nv END AS near_v FROM bf"""))
def nearest_time(spark, sf):
    asked, samples = event_series(spark, sf)
    return S.nearest_sample(asked, samples, ["user_id"], "t", "value").select("event_id", "user_id", "near_v")


@register("as_of_interpolation", with_sql(ASOF, body="""
SELECT event_id, user_id, round(CASE WHEN pt IS NULL THEN 0 WHEN nt IS NULL THEN pv ELSE (1 - (t-pt)/(nt-pt))*pv + (t-pt)/(nt-pt)*nv END, 6) AS value FROM bf"""))
def interpolated(spark, sf):
    asked, samples = event_series(spark, sf)
    return S.interpolated(asked, samples, ["user_id"], "t", "value").select("event_id", "user_id", F.round("value", 6).alias("value"))


@register("rank_siblings", with_sql(FOREST_SQL, body="""
SELECT tree, parent_id, id, CAST(row_number() OVER (PARTITION BY tree, parent_id ORDER BY radius_mm DESC, id) AS INTEGER) AS rank FROM seg WHERE parent_id > 0"""))
def siblings(spark, sf):
    from arborlake.operators.growth import ranked_siblings

    return ranked_siblings(forest(spark, sf), F.col("radius_mm").desc(), "id").select("tree", "parent_id", "id", "rank")


@register("territory_shares", with_sql("nn AS (SELECT n_nationkey, n_regionkey, (n_nationkey % 5 - 1) * 1.0 AS f FROM nation)", body="""
SELECT n_nationkey, round(greatest(f, 0) / sum(greatest(f, 0)) OVER (), 9) AS overall,
 round(CASE WHEN sum(greatest(f, 0)) OVER (PARTITION BY n_regionkey) > 0 THEN greatest(f, 0) / sum(greatest(f, 0)) OVER (PARTITION BY n_regionkey)
 ELSE 1.0 / count(*) OVER (PARTITION BY n_regionkey) END, 9) AS per_region FROM nn"""))
def shares(spark, sf):
    n = table(spark, sf, "nation").withColumn("f", (F.col("n_nationkey") % 5 - 1) * 1.0)
    a = ranking.shares(n, [], "f").select("n_nationkey", F.round("share", 9).alias("overall"))
    b = ranking.shares(n, ["n_regionkey"], "f").select("n_nationkey", F.round("share", 9).alias("per_region"))
    return a.join(b, "n_nationkey")


@register("top_k_by_path_length", with_sql(FOREST_SQL, """pt AS (SELECT tree, id, length_mm AS way FROM seg WHERE parent_id < 0
  UNION ALL SELECT s.tree, s.id, p.way + s.length_mm FROM pt p JOIN seg s ON s.tree = p.tree AND s.parent_id = p.id)""", recursive=True, body=f"""
SELECT tree, id, {sig_sql('way')} AS way FROM pt ORDER BY pt.way DESC, tree, id LIMIT 12"""))
def top_paths(spark, sf):
    way = trees.path_sums(forest(spark, sf), {"way": F.col("length_mm")})
    return ranking.top_k(way, F.col("way"), 12, ["tree", "id"]).select("tree", "id", sig(F.col("way")).alias("way"))


EVEN = """rk AS (SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY id) AS r, count(*) OVER (PARTITION BY tree) AS n FROM {src}),
pk AS (SELECT tree, CAST(round_even(1 + i * (n - 1) / ({m} - 1.0), 0) AS BIGINT) AS r FROM (SELECT DISTINCT tree, n FROM rk), range(0, {m}) q(i))"""


@register("even_subsample", with_sql(FOREST_SQL, EVEN.format(src="seg", m=60), body="SELECT tree, id FROM rk WHERE n <= 60 OR (tree, r) IN (SELECT tree, r FROM pk)"))
def even(spark, sf):
    r = ranking.ranked(forest(spark, sf).select("tree", "id"), ["tree"], "id", []).withColumnsRenamed({"upto": "_r", "total": "_n"})
    return ranking.spread_evenly(r, F.lit(60)).select("tree", "id")


@register("stratified_decimation", with_sql(FOREST_SQL, """
o AS (SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY radius_mm DESC, id) AS dn, row_number() OVER (PARTITION BY tree ORDER BY radius_mm, id) AS un FROM seg),
md AS (SELECT * FROM o WHERE dn > 50 AND un > 90)""", EVEN.format(src="md", m=60), body="""
SELECT tree, id FROM o WHERE dn <= 50 OR un <= 90 UNION ALL SELECT tree, id FROM rk WHERE (tree, r) IN (SELECT tree, r FROM pk)"""))
def decimation(spark, sf):
    return ranking.decimate(forest(spark, sf).select("tree", "id", "radius_mm"), ["tree"], "radius_mm", ["id"], 200).select("tree", "id")


@register("display_layers", with_sql(FOREST_SQL, """
o AS (SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY radius_mm DESC, id) AS dn, row_number() OVER (PARTITION BY tree ORDER BY radius_mm, id) AS un FROM seg),
md AS (SELECT * FROM o WHERE dn > 35)""", EVEN.format(src="md", m=65), """
md2 AS (SELECT * FROM o WHERE dn > 50 AND un > 90)""", EVEN.format(src="md2", m=60).replace("rk ", "rk2 ").replace("FROM rk)", "FROM rk2)").replace("pk AS", "pk2 AS"), body="""
SELECT 'static' AS layer, tree, id FROM o WHERE dn <= 35 UNION ALL SELECT 'static', tree, id FROM rk WHERE (tree, r) IN (SELECT tree, r FROM pk)
UNION ALL SELECT 'dynamic', tree, id FROM o WHERE dn <= 50 OR un <= 90 UNION ALL SELECT 'dynamic', tree, id FROM rk2 WHERE (tree, r) IN (SELECT tree, r FROM pk2)"""))
def display_layers(spark, sf):
    from arborlake.operators.report import layers

    segs = forest(spark, sf).select("tree", "id", "radius_mm")
    static = ranking.decimate_static(segs, ["tree"], "radius_mm", ["id"], 100)
    return layers({"static": static, "dynamic": ranking.decimate(segs, ["tree"], "radius_mm", ["id"], 200)}).select("layer", "tree", "id")


@register("display_series", with_sql(FOREST_SQL, TIMES, SERIES, """
o AS (SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY radius_mm DESC, id) AS dn, row_number() OVER (PARTITION BY tree ORDER BY radius_mm, id) AS un FROM seg WHERE radius_mm*1000 >= 4),
md AS (SELECT * FROM o WHERE dn > 50 AND un > 90)""", EVEN.format(src="md", m=60), """
kp AS (SELECT tree, id FROM o WHERE dn <= 50 OR un <= 90 UNION ALL SELECT tree, id FROM rk WHERE (tree, r) IN (SELECT tree, r FROM pk))""", body=f"""
SELECT s.tree, s.id, s.t_idx, {sig_sql('s.value')} AS value, round((g.px+g.dx)/2, 6) AS mx, {sig_sql('g.radius_mm*2000')} AS diameter_um,
 round(least(greatest(10*sqrt(g.radius_mm), 1.4), 8), 6) AS marker, {sig_sql('max(s.value) OVER ()')} AS top FROM ser s JOIN kp k ON k.tree = s.tree AND k.id = s.id
 JOIN seg g ON g.tree = s.tree AND g.id = s.id WHERE s.t_idx % 4 = 0"""))
def display(spark, sf):
    from arborlake.operators.report import display_rows

    rows = display_rows(forest(spark, sf), long_series(spark, sf).select("tree", "id", "t_idx", "value"), 4.0, 200, 4)
    return rows.select("tree", "id", "t_idx", sig(F.col("value")).alias("value"), F.round("mx", 6).alias("mx"), sig(F.col("diameter_um")).alias("diameter_um"),
                       F.round("marker", 6).alias("marker"), sig(F.col("top")).alias("top"))


@register("forest_union", with_sql(FOREST_SQL, body="SELECT tree, count(*) AS n, min(id) AS first_id FROM seg GROUP BY 1 ORDER BY 1"))
def forest_union(spark, sf):
    from arborlake.operators.report import union_forest

    segs = forest(spark, sf)
    parts = {n: segs.where(F.col("tree") == n).drop("tree") for n in ("RCA", "LAD", "LCX")}
    return union_forest(parts).groupBy("tree").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy("tree")


@register("grown_part_only", with_sql(FOREST_SQL, body="SELECT tree, id FROM seg WHERE id > CASE tree WHEN 'LAD' THEN 10 WHEN 'LCX' THEN 20 ELSE 0 END"))
def grown(spark, sf):
    from arborlake.operators.report import grown_part

    fixed = spark.createDataFrame([("LAD", 10), ("LCX", 20)], "tree string, n_fixed int")
    return grown_part(forest(spark, sf), fixed).select("tree", "id")


@register("common_names", "SELECT DISTINCT p_name AS name FROM part WHERE p_size > 40 INTERSECT SELECT p_name FROM part WHERE p_size < 10")
def common(spark, sf):
    part = table(spark, sf, "part")
    return part.where("p_size > 40").select(F.col("p_name").alias("name")).intersect(part.where("p_size < 10").select(F.col("p_name").alias("name")))
