"""Tensor-product surfaces: sampling, centerlines of tubes, shells.

Tables: surfaces (surface, m, n), knots (surface, dir, idx, value) with dir 'u'
along the n columns and 'v' along the m rows, control_points (surface, row, col, x, y, z).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.functions.vectors import cross, dot, norm, sub, triple
from arborlake.operators import filters
from arborlake.plans.cut import cut
from arborlake.plans.lookup import lookup
from arborlake.plans.running import first_rows

DELTA = 1e-4  # step of the finite difference for normals
SMALL_NET = 256  # control points of a surface that are held in its row


def open_uniform_knots(n_ctrl: int, degree: int) -> list[float]:
    if n_ctrl <= degree:
        raise ValueError("needs more control points than the degree")
    inner = n_ctrl - degree
    return [0.0] * (degree + 1) + [i / inner for i in range(1, inner)] + [1.0] * (degree + 1)


def basis(u: Column, knots: Column, n: Column) -> Column:
    """All n basis values at u for a knot array; the degree follows from the lengths."""
    degree = F.size(knots) - n - 1

    def k(i: Column) -> Column:
        return F.get(knots, i)

    def span(i: Column) -> Column:
        within = (k(i) <= u) & (u < k(i + 1))
        end = (u == F.element_at(knots, -1)) & (i == n - 1) & (k(i) <= u) & (u <= k(i + 1))
        return F.when(within | end, F.lit(1.0)).otherwise(F.lit(0.0))

    def raise_degree(b: Column, d: Column) -> Column:
        def value(i: Column) -> Column:
            left, right = k(i + d) - k(i), k(i + d + 1) - k(i + 1)
            a = F.when(left > 0, (u - k(i)) / left * F.get(b, i)).otherwise(F.lit(0.0))
            c = F.when(right > 0, (k(i + d + 1) - u) / right * F.get(b, i + 1)).otherwise(F.lit(0.0))
            return a + c

        return F.transform(F.sequence(F.lit(0), F.size(knots) - 2 - d), value)

    start = F.transform(F.sequence(F.lit(0), F.size(knots) - 2), span)
    steps = F.when(degree > 0, F.sequence(F.lit(1), degree)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, raise_degree)


def _knot_arrays(knots: DataFrame) -> DataFrame:
    sorted_values = F.array_sort(F.collect_list(F.struct("idx", "value")))["value"]
    arrays = knots.groupBy("surface", "dir").agg(sorted_values.alias("k"))
    return arrays.groupBy("surface").agg(
        F.max(F.when(F.col("dir") == "u", F.col("k"))).alias("ku"), F.max(F.when(F.col("dir") == "v", F.col("k"))).alias("kv"))


def degrees(surfaces: DataFrame, knots: DataFrame) -> DataFrame:
    """(surface, p_u, p_v) from the numbers of knots; a negative degree is an error."""
    size = surfaces.join(_knot_arrays(knots), "surface")
    p_u, p_v = F.size("ku") - F.col("n") - 1, F.size("kv") - F.col("m") - 1
    bad = F.raise_error(F.concat(F.lit("too few knots for "), F.col("surface"))).cast("int")
    ok = (p_u >= 0) & (p_v >= 0)
    return size.select("surface", F.when(ok, p_u).otherwise(bad).alias("p_u"), F.when(ok, p_v).otherwise(bad).alias("p_v"))


def sample(surfaces: DataFrame, knots: DataFrame, control_points: DataFrame, n_u: Column, n_v: Column, outward: bool = False) -> DataFrame:
    """(surface, j, i, u, v, x, y, z, nx, ny, nz) on a grid of n_u x n_v parameters per surface.

    Only the non-zero basis products meet their control points, so a sample costs
    (p_u + 1)(p_v + 1) rows per evaluated place.  Nets of up to ``SMALL_NET`` points travel with their surface; of larger
    ones the products are joined.  Spark takes exploded rows for small, so joins are told to broadcast none.
    """
    spark = surfaces.sparkSession
    largest = control_points.groupBy("surface").count().agg(F.max("count")).first()[0] or 0
    # A short table of surfaces would be one task, which then makes all samples.
    sized = surfaces.withColumns({"_nu": n_u, "_nv": n_v}).join(_knot_arrays(knots).hint("merge"), "surface")
    point = F.struct("row", "col", "x", "y", "z")
    if largest <= SMALL_NET:
        sized = sized.join(control_points.groupBy("surface").agg(F.collect_list(point).alias("_net")).hint("merge"), "surface")
    else:
        sized = sized.withColumn("_net", F.lit(None))
    sized = sized.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "surface")

    def nonzero(values: Column, name: str) -> Column:
        pairs = F.transform(values, lambda b, i: F.struct((i + 1).alias(name), b.alias("b")))
        return F.filter(pairs, lambda p: p["b"] != 0)

    def shaped(values: Column, name: str) -> Column:
        return values if largest <= SMALL_NET else nonzero(values, name)

    def along(size: str, knots_of: str, n: str, name: str) -> Column:
        """Of each parameter the basis there, a step below and a step above: once a row and a column, not once a place."""
        def three(i: Column) -> Column:
            t = i / F.greatest(F.col(size) - 1, F.lit(1))
            near = (t, F.greatest(t - DELTA, F.lit(0.0)), F.least(t + DELTA, F.lit(1.0)))
            return F.struct(i.alias("i"), t.alias("t"), F.array(*[shaped(basis(x, F.col(knots_of), F.col(n)), name) for x in near]).alias("b"))

        return F.transform(F.sequence(F.lit(0), F.col(size) - 1), three)

    at = sized.select("surface", "_net", along("_nu", "ku", "n", "col").alias("_us"), along("_nv", "kv", "m", "row").alias("_vs"))
    at = at.select("surface", "_net", "_us", F.explode("_vs").alias("_v")).select("surface", "_net", "_v", F.explode("_us").alias("_u"))
    places = [(0, 0), (1, 0), (2, 0), (0, 1), (0, 2)]  # itself, below and above along u, below and above along v
    spread = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col("_u.b")[a].alias("u"), F.col("_v.b")[b].alias("v")) for w, (a, b) in enumerate(places)]))
    weighted = at.select("surface", "_net", F.col("_v.i").alias("j"), F.col("_u.i").alias("i"), F.col("_u.t").alias("u"), F.col("_v.t").alias("v"), spread.alias("_w"))
    place = ["surface", "j", "i", "u", "v"]
    if largest <= SMALL_NET:
        def product(p: Column) -> Column:
            across, down = F.get(F.col("_w.u"), p["col"] - 1), F.get(F.col("_w.v"), p["row"] - 1)
            return F.when((across != 0) & (down != 0), across * down)

        meet = F.transform("_net", lambda p: F.struct(product(p).alias("b"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
        met = weighted.select(*place, F.col("_w.w").alias("w"), F.inline(F.filter(meet, lambda p: p["b"].isNotNull())))
    else:
        rows = weighted.select(*place, F.col("_w.w").alias("w"), F.col("_w.v").alias("_bv"), F.explode("_w.u").alias("_cu")).select(
            *place, "w", "_cu", F.explode("_bv").alias("_cv")).select(
            *place, "w", F.col("_cv.row").alias("row"), F.col("_cu.col").alias("col"), (F.col("_cu.b") * F.col("_cv.b")).alias("b"))
        met = rows.hint("merge").join(control_points, ["surface", "row", "col"])
    sums = [F.sum(F.when(F.col("w") == n, F.col("b") * F.col(a))).alias(f"_{a}{n}") for n in range(5) for a in "xyz"]
    found = met.groupBy("surface", "j", "i", "u", "v").agg(*sums)
    p = [triple(*[f"_{a}{n}" for a in "xyz"]) for n in range(5)]
    normal = cross(sub(p[2], p[1]), sub(p[4], p[3]))
    found = found.withColumns({f"_n{a}": c for a, c in zip("xyz", normal)})
    length = norm(triple("_nx", "_ny", "_nz"))
    out = found.select(
        "surface", "j", "i", "u", "v", *[F.col(f"_{a}0").alias(a) for a in "xyz"],
        *[F.when(length > 0, F.col(f"_n{a}") / length).otherwise(F.lit(d)).alias(f"n{a}") for a, d in zip("xyz", (0.0, 0.0, 1.0))])
    if not outward:
        return out
    out = cut(out, "sampled")
    centre = out.groupBy("surface").agg(*[F.avg(a).alias(f"_c{a}") for a in "xyz"])
    met = lookup(out, centre, ["surface"], out.count())
    inward = dot(triple("nx", "ny", "nz"), sub(triple("x", "y", "z"), triple("_cx", "_cy", "_cz"))) < 0
    return met.withColumns({f"n{a}": F.when(inward, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")) for a in "xyz"}).drop("_cx", "_cy", "_cz")


def axes(surfaces: DataFrame, control_points: DataFrame) -> DataFrame:
    """(surface, axial): the direction that does not close on itself; 'v' on a tie."""
    sized = control_points.join(surfaces, "surface")
    spot = F.struct("x", "y", "z")

    def closure(edge: str, other: str, last: str) -> DataFrame:
        pair = sized.where((F.col(edge) == 1) | (F.col(edge) == F.col(last))).groupBy("surface", other).agg(
            F.min_by(spot, edge).alias("a"), F.max_by(spot, edge).alias("b"))
        gap = norm(sub(triple("x", "y", "z", of="a"), triple("x", "y", "z", of="b")))
        return pair.groupBy("surface").agg(F.avg(gap).alias(f"_{edge}"))

    both = closure("col", "row", "n").join(closure("row", "col", "m"), "surface")
    return both.select("surface", F.when(F.col("_col") <= F.col("_row"), "v").otherwise("u").alias("axial"))


def tube_centerlines(surfaces: DataFrame, knots: DataFrame, control_points: DataFrame, ring: int = 48) -> DataFrame:
    """Line points of tube surfaces: mean of every ring and its mean distance, end caps trimmed."""
    along = surfaces.join(axes(surfaces, control_points), "surface")
    is_v = F.col("axial") == "v"
    n_axial = F.when(is_v, F.greatest(F.lit(16), F.col("m") * 2)).otherwise(F.greatest(F.lit(16), F.col("n") * 2))
    n_ring = F.lit(max(12, ring))
    pts = sample(along.select("surface", "m", "n", "axial"), knots, control_points,
                 F.when(is_v, n_ring).otherwise(n_axial), F.when(is_v, n_axial).otherwise(n_ring))
    pts = pts.join(along.select("surface", "axial"), "surface").withColumn("pos", F.when(is_v, F.col("j")).otherwise(F.col("i")) + 1)
    # A ring is a fixed, small number of points.
    w = Window.partitionBy("surface", "pos")
    c = tuple(F.avg(a).over(w) for a in "xyz")
    ringed = pts.withColumns({f"_c{a}": v for a, v in zip("xyz", c)})
    away = norm(sub(triple("x", "y", "z"), triple("_cx", "_cy", "_cz")))
    line = ringed.groupBy("surface", "pos").agg(*[F.first(f"_c{a}").alias(a) for a in "xyz"], F.avg(away).alias("radius_mm"))
    return filters.trim_end_caps(cut(line.withColumnRenamed("surface", "line"), "tubes"))


def shell_from_surfaces(surfaces: DataFrame, knots: DataFrame, control_points: DataFrame, n_u: int, n_v: int, scale: float = 1.0) -> DataFrame:
    """Surface samples with outward normals and scaled places, ready for the shell distance."""
    pts = sample(surfaces, knots, control_points, F.lit(n_u), F.lit(n_v), outward=True)
    return pts.select("surface", (F.col("j") * n_u + F.col("i")).cast("bigint").alias("id"), *[(F.col(a) * scale).alias(a) for a in "xyz"], "nx", "ny", "nz")


def interior_points(samples: DataFrame, outer: str, cavities: list[str], target: int, max_draws: int, seed: int) -> tuple[DataFrame, Column]:
    """Places drawn in the box of the outer surface and kept inside the shell, and the volume as a scalar."""
    import math

    from arborlake.operators import spatial, synth

    box = samples.where(F.col("surface") == outer).agg(*[f(a) for a in "xyz" for f in (F.min, F.max)]).first()
    low, high = box[0::2], box[1::2]
    drawn = synth.box_points(samples.sparkSession, low, high, max_draws, seed).withColumnRenamed("sample", "qid")
    judged = cut(drawn.join(spatial.shell_distance(drawn, samples, outer, cavities).select("qid", "shell_sd"), "qid"), "judged")
    volume = math.prod(h - l for l, h in zip(low, high)) * judged.agg(F.avg((F.col("shell_sd") <= 0).cast("double"))).scalar()
    return first_rows(cut(judged.where("shell_sd <= 0"), "kept"), "qid", target), volume


def tube_nets(segs: DataFrame, ring: int = 8, prefix: str = "grown") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every segment as a 2 x (ring + 1) control net: surfaces, knots and control points."""
    import math

    from arborlake.functions.vectors import perpendicular

    name = F.concat(F.lit(prefix + "_"), F.col("tree"), F.lit("_"), F.lpad(F.col("id").cast("string"), 7, "0"))
    named = segs.withColumn("surface", name)
    surfaces = named.select("surface", F.lit(2).alias("m"), F.lit(ring + 1).alias("n"))
    values = [F.struct(F.lit(d).alias("dir"), F.lit(i + 1).alias("idx"), F.lit(v).alias("value"))
              for d, ks in (("u", open_uniform_knots(ring + 1, 1)), ("v", [0.0, 0.0, 1.0, 1.0])) for i, v in enumerate(ks)]
    knots = named.select("surface", F.inline(F.array(*values)))
    axis = sub(triple("dx", "dy", "dz"), triple("px", "py", "pz"))
    based = named.withColumns({**{f"_a{c}": v for c, v in zip("xyz", axis)}, "_l": norm(axis)})
    flat = F.col("_l") < 1e-12
    based = based.withColumns({f"_a{c}": F.when(flat, F.lit(d)).otherwise(F.col(f"_a{c}") / F.col("_l")) for c, d in zip("xyz", (1.0, 0.0, 0.0))})
    a = triple("_ax", "_ay", "_az")
    based = based.withColumns({f"_u{c}": v for c, v in zip("xyz", perpendicular(a))})
    u = triple("_ux", "_uy", "_uz")
    turned = based.withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(ring + 1)))).withColumn("row", F.explode(F.array(F.lit(1), F.lit(2))))
    angle = 2 * math.pi * (F.col("col") - 1) / ring
    side = tuple(F.cos(angle) * x + F.sin(angle) * y for x, y in zip(u, cross(a, u)))
    place = [F.when(F.col("row") == 1, F.col(f"p{c}")).otherwise(F.col(f"d{c}")) + F.col("radius_mm") * s for c, s in zip("xyz", side)]
    points = turned.select("surface", "row", "col", *[v.alias(c) for c, v in zip("xyz", place)])
    return surfaces, knots, points


def facets(segs: DataFrame, around: int = 8) -> DataFrame:
    """Triangles of every segment as an open cylinder: 2 * around rows with corners a, b, c and the unit normal."""
    import math

    from arborlake.functions.vectors import perpendicular

    axis = sub(triple("dx", "dy", "dz"), triple("px", "py", "pz"))
    based = segs.withColumns({**{f"_a{c}": v for c, v in zip("xyz", axis)}, "_l": norm(axis)})
    flat = F.col("_l") < 1e-15
    based = based.withColumns({f"_a{c}": F.when(flat, F.lit(d)).otherwise(F.col(f"_a{c}") / F.col("_l")) for c, d in zip("xyz", (1.0, 0.0, 0.0))})
    a = triple("_ax", "_ay", "_az")
    based = based.withColumns({f"_u{c}": v for c, v in zip("xyz", perpendicular(a))})
    u = triple("_ux", "_uy", "_uz")
    based = based.withColumns({f"_v{c}": v for c, v in zip("xyz", cross(a, u))})
    sides = based.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(around - 1)))).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))

    def ring(k: Column, end: str) -> Column:
        t = 2 * math.pi * (k % around) / around
        return F.struct(*[(F.col(f"{end}{c}") + F.col("radius_mm") * (F.cos(t) * F.col(f"_u{c}") + F.sin(t) * F.col(f"_v{c}"))).alias(c) for c in "xyz"])

    k, k2 = F.col("side"), F.col("side") + 1
    first = F.col("half") == 0
    placed = sides.select("tree", "id", "side", "half", F.when(first, ring(k, "p")).otherwise(ring(k2, "p")).alias("a"), ring(k, "d").alias("b"),
                          F.when(first, ring(k2, "p")).otherwise(ring(k2, "d")).alias("c"))
    e1 = sub(triple("x", "y", "z", of="b"), triple("x", "y", "z", of="a"))
    e2 = sub(triple("x", "y", "z", of="c"), triple("x", "y", "z", of="a"))
    placed = placed.withColumns({f"_n{c}": v for c, v in zip("xyz", cross(e1, e2))})
    length = norm(triple("_nx", "_ny", "_nz"))
    return placed.select("tree", "id", "side", "half", "a", "b", "c", *[
        F.when(length > 0, F.col(f"_n{c}") / length).otherwise(F.lit(0.0)).alias(f"n{c}") for c in "xyz"])
