"""Voxel operators. Indices are 1-based with the first axis fastest."""

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from arborlake.functions import flow
from arborlake.plans.cut import cut, cut_counted, work_dir
from arborlake.plans.lookup import lookup

IJK = ["i", "j", "k"]


@dataclass(frozen=True)
class Grid:
    origin: tuple[float, float, float]
    spacing: tuple[float, float, float]
    dims: tuple[int, int, int]

    def linear(self, i: Column, j: Column, k: Column) -> Column:
        return i + (j - 1) * self.dims[0] + (k - 1) * self.dims[0] * self.dims[1]


def grid_around(bounds: dict[str, float], spacing, padding) -> Grid:
    """Grid over a box (x0..z1) widened by a padding."""
    low = [bounds[f"{a}0"] - p for a, p in zip("xyz", padding)]
    high = [bounds[f"{a}1"] + p for a, p in zip("xyz", padding)]
    dims = [max(1, -int(-(h - l) // s)) for l, h, s in zip(low, high, spacing)]
    return Grid(tuple(low), tuple(float(s) for s in spacing), tuple(dims))


SLABS = 64  # voxels of one axis a row is spread over at a time
CELLS = 65_536  # voxels that one step of a task looks at together


def segment_hits(segs: DataFrame, grid: Grid, supersample: int = 2, keys=("tree", "id")) -> DataFrame:
    """(keys, i, j, k, share): share of the sub-points of a voxel within the radius of a segment.

    The box of a segment is cut into pieces of planes, which are dealt out over
    the cluster, so that one segment with a large box does not keep one task
    busy.  A task looks at ``CELLS`` voxels at a time, whatever their pieces;
    the loop over sub-points is too long for a compiled stage.
    """
    r = F.col("radius_mm")
    ranges = {}
    for a, o, s, n in zip("xyz", grid.origin, grid.spacing, grid.dims):
        lo, hi = F.least(f"p{a}", f"d{a}") - r, F.greatest(f"p{a}", f"d{a}") + r
        ranges[f"_{a}0"] = F.least(F.greatest(F.floor((lo - o) / s) + 1, F.lit(1)), F.lit(n)).cast("int")
        ranges[f"_{a}1"] = F.least(F.greatest(F.ceil((hi - o) / s), F.lit(1)), F.lit(n)).cast("int")
    boxed = segs.select(*keys, "px", "py", "pz", "dx", "dy", "dz", "radius_mm").withColumns(ranges)
    slab = F.explode(F.sequence(F.col("_z0"), F.greatest(F.col("_z0"), F.col("_z1")), F.lit(SLABS)))
    row = F.explode(F.sequence(F.col("_y0"), F.greatest(F.col("_y0"), F.col("_y1")), F.lit(SLABS)))
    # Boxes cut in two axes are dealt out before they unfold: a piece is at most SLABS x SLABS rows of voxels.
    slabs = boxed.withColumn("_slab", slab).withColumn("_row", row).repartition(*keys, "_slab", "_row")
    ends = [*[f"p{a}" for a in "xyz"], *[f"d{a}" for a in "xyz"], "radius_mm"]
    box = ["_x0", "_x1", "_row", "_y1", "_slab", "_z1"]
    pieces = slabs.withColumns({
        "_x1": F.greatest("_x0", "_x1"),
        "_y1": F.least(F.greatest("_y0", "_y1"), F.col("_row") + SLABS - 1),
        "_z1": F.least(F.greatest("_z0", "_z1"), F.col("_slab") + SLABS - 1)})
    # A row without one of its numbers covers nothing.
    pieces = pieces.select(*keys, *[F.col(c).cast("double").alias(c) for c in ends], *box).dropna(subset=ends)
    origin, spacing = [float(o) for o in grid.origin], [float(s) for s in grid.spacing]
    names, cells = list(keys), CELLS

    def run(batches):
        def with_nan(u, v):  # as Spark compares: NaN is the largest number
            return (u <= v) | np.isnan(v)

        steps = [h / supersample for h in spacing]
        for batch in batches:
            if not batch.num_rows:
                continue
            x0, x1, y0, y1, z0, z1 = (batch.column(c).to_numpy().astype(np.int64) for c in box)
            nx, ny = x1 - x0 + 1, y1 - y0 + 1
            upto = np.cumsum(nx * ny * (z1 - z0 + 1))
            number = {c: batch.column(c).to_numpy() for c in ends}
            # No product of numbers below this limit leaves the range of a double.
            at_most = np.less_equal if all((np.abs(v) < 1e70).all() for v in number.values()) else with_nan
            for low in range(0, int(upto[-1]), cells):
                cell = np.arange(low, min(low + cells, int(upto[-1])))
                of = np.searchsorted(upto, cell, "right")
                cell -= np.append(0, upto)[of]
                ijk = [x0[of] + cell % nx[of], y0[of] + cell // nx[of] % ny[of], z0[of] + cell // (nx[of] * ny[of])]
                p = [number[f"p{c}"][of] for c in "xyz"]
                a = [number[f"d{c}"][of] - p[n] for n, c in enumerate("xyz")]
                # First sub-point of the voxel relative to the proximal end, then all sub-points by their constant offsets.
                w = [o + (n - 1 + 0.5 / supersample) * h - v for n, o, h, v in zip(ijk, origin, spacing, p)]
                aa, wa0, ww0 = (u[0] * v[0] + u[1] * v[1] + u[2] * v[2] for u, v in ((a, a), (w, a), (w, w)))
                rr = number["radius_mm"][of] * number["radius_mm"][of]
                count = np.zeros(len(of), np.int64)
                for sz in range(supersample):
                    for sy in range(supersample):
                        for sx in range(supersample):
                            off = [sx * steps[0], sy * steps[1], sz * steps[2]]
                            wa = wa0 + off[0] * a[0] + off[1] * a[1] + off[2] * a[2]
                            ww = ww0 + 2 * (off[0] * w[0] + off[1] * w[1] + off[2] * w[2]) + sum(v * v for v in off)
                            # Nearest to the proximal end, to the distal end, or to a place between.
                            count += np.where(at_most(wa, 0.0), at_most(ww, rr), np.where(
                                at_most(aa, wa), at_most(ww - 2 * wa + aa, rr), at_most(ww * aa - wa * wa, rr * aa)))
                some = np.flatnonzero(count)
                rows = pa.array(of[some])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in names], *[pa.array(n[some].astype(np.int32)) for n in ijk],
                     pa.array(count[some] / supersample**3)], names=[*names, "i", "j", "k", "share"])

    hit = T.StructType([*[segs.schema[c] for c in keys], *[T.StructField(c, T.IntegerType()) for c in IJK], T.StructField("share", T.DoubleType())])
    return pieces.mapInArrow(run, hit)


def occupancy(hits: DataFrame) -> DataFrame:
    """Plain sum of shares per voxel; may exceed 1."""
    return hits.groupBy(*IJK).agg(F.sum("share").alias("occupancy"))


def mean_values(hits: DataFrame, series: DataFrame, keys=("tree", "id")) -> DataFrame:
    """(i, j, k, t_idx, occupancy, value): share-weighted mean of the segment series per voxel and time."""
    met = hits.join(series.select(*keys, "t_idx", "value"), list(keys))
    return met.groupBy(*IJK, "t_idx").agg(
        F.sum("share").alias("occupancy"), (F.sum(F.col("share") * F.col("value")) / F.sum("share")).alias("value"))


def union_coverage(hits: DataFrame, series: DataFrame, keys=("tree", "id"), by=("t_idx",), min_fraction: float = 1e-4) -> DataFrame:
    """(by, i, j, k, phi, value): phi = 1 - product(1 - share), share-weighted value; faint voxels dropped."""
    met = hits.join(series.select(*keys, *by, "value"), list(keys))
    out = met.groupBy(*by, *IJK).agg(
        (1 - F.product(1 - F.col("share"))).alias("phi"),
        (F.sum(F.col("share") * F.col("value")) / F.sum("share")).alias("value"))
    return out.where(F.col("phi") >= min_fraction)


def dynamic_classes(covered: DataFrame, labels: DataFrame, materials: DataFrame, phi_bins: list[float], value_bins: list[float], by=("t_idx",)) -> DataFrame:
    """Adds host label, bins (from 1) and the new label, numbered per frame from the highest known label on.

    New labels follow the order of (host, phi bin, value bin).  A voxel whose
    host has no material is an error.
    """
    hosted = covered.join(labels.withColumnRenamed("label", "host"), IJK).withColumns({
        "phi_bin": flow.nearest_bin(F.col("phi"), phi_bins), "value_bin": flow.nearest_bin(F.col("value"), value_bins)})
    keys = ["host", "phi_bin", "value_bin"]
    classes = hosted.groupBy(*by, *keys).agg(F.count("*").alias("n_voxels"))
    # A frame has at most hosts x bins classes.
    w = Window.partitionBy(*by).orderBy(*keys)
    last = materials.agg(F.max("label")).scalar()
    known = materials.select(F.col("label").alias("host"), F.lit(True).alias("_known"))
    named = classes.join(known, "host", "left").withColumn("label", (last + F.row_number().over(w)).cast("int"))
    named = named.withColumn("label", F.when(F.col("_known"), F.col("label")).otherwise(
        F.raise_error(F.concat(F.lit("no material for label "), F.col("host").cast("string"))).cast("int"))).drop("_known")
    return hosted.join(named.select(*by, *keys, "label"), [*by, *keys])


@dataclass(frozen=True)
class FrameStore:
    """Labelled time frames as one base volume and the voxels that differ from it, by frame."""

    base: DataFrame
    changes: DataFrame
    by: str = "t_idx"


def store_frames(labels: DataFrame, changed: DataFrame, by: str = "t_idx", folder: str | None = None) -> FrameStore:
    """Writes the base once, in order of its slices, and the changes of each frame into a folder of its own."""
    spark = labels.sparkSession
    place = folder or f"{work_dir(spark)}/frames-{uuid.uuid4().hex}"
    labels.repartitionByRange("k", "j", "i").sortWithinPartitions("k", "j", "i").write.parquet(f"{place}/base")
    new = changed.select(by, *IJK, F.col("label").alias("_new"))
    new.repartitionByRange(by, "k", "j", "i").sortWithinPartitions(by, "k", "j", "i").write.partitionBy(by).parquet(f"{place}/changes")
    kind = new.schema[by].dataType
    changes = spark.read.schema(new.schema).parquet(f"{place}/changes").withColumn(by, F.col(by).cast(kind))
    return FrameStore(spark.read.schema(labels.schema).parquet(f"{place}/base"), changes, by)


def read_frame(store: FrameStore, frame, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None) -> DataFrame:
    """Label volume of one frame, or its part between two corners: the base, replaced where a voxel changed.

    Only the folder of the frame is read, and of base and changes only the slices asked for.
    """
    inside = F.lit(True)
    if low is not None:
        for c, a, b in zip(IJK, low, high):
            inside = inside & F.col(c).between(a, b)
    new = store.changes.where((F.col(store.by) == frame) & inside).drop(store.by)
    met = store.base.where(inside).join(new, list(IJK), "left")
    return met.withColumn("label", F.coalesce("_new", "label")).drop("_new")


def read_frames(store: FrameStore, frames: DataFrame) -> DataFrame:
    """Label volumes of all frames of a table, one row per frame and voxel."""
    wanted = frames.agg(F.array_sort(F.collect_set(store.by))).scalar()  # one number a frame
    base = store.base.withColumn(store.by, F.explode(wanted))
    return base.join(store.changes, [store.by, *IJK], "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def label_box(labels: DataFrame, wanted: list[int]) -> DataFrame:
    """One row with the index box of labels; an error when none is present."""
    hit = labels.where(F.col("label").isin(wanted))
    box = hit.agg(*[f(a).alias(f"{a}{n}") for a in IJK for n, f in ((0, F.min), (1, F.max))])
    return box.withColumn("i0", F.when(F.col("i0").isNull(), F.raise_error(F.lit("label not present")).cast("int")).otherwise(F.col("i0")))


def estimated_origin(box_a: DataFrame, centre_a, box_b: DataFrame, centre_b, spacing) -> DataFrame:
    """Grid origin as the mean of two estimates: surface centre - (index centre - 1) * spacing."""
    def est(centre, prefix):
        return [c - ((F.col(f"{prefix}{a}0") + F.col(f"{prefix}{a}1")) / 2 - 1) * s for a, c, s in zip(IJK, centre, spacing)]

    both = box_a.select(F.lit(1).alias("_"), *[F.col(c).alias(f"a_{c}") for c in box_a.columns]).join(
        box_b.select(F.lit(1).alias("_"), *[F.col(c).alias(f"b_{c}") for c in box_b.columns]), "_")
    return both.select(*[((u + v) / 2).alias(f"{n}0") for u, v, n in zip(est(centre_a, "a_"), est(centre_b, "b_"), "xyz")])


def crop_to_labels(labels: DataFrame, wanted: list[int], spacing: tuple, padding: float, dims: tuple) -> tuple[DataFrame, tuple]:
    """Voxels of the padded label box, renumbered from 1, and the index shift; unchanged when no label is present."""
    row = labels.where(F.col("label").isin(wanted)).agg(*[f(a) for a in IJK for f in (F.min, F.max)]).first()
    if row[0] is None:
        return labels, (0, 0, 0)
    low = [max(1, row[2 * n] - -int(-padding // s)) for n, s in enumerate(spacing)]
    high = [min(dims[n], row[2 * n + 1] + -int(-padding // s)) for n, s in enumerate(spacing)]
    inside = labels
    for a, l, h in zip(IJK, low, high):
        inside = inside.where(F.col(a).between(l, h))
    return inside.withColumns({a: F.col(a) - (l - 1) for a, l in zip(IJK, low)}), tuple(l - 1 for l in low)


def downsample(labels: DataFrame, dims: tuple, factor: int) -> DataFrame:
    """Nearest-neighbour: index (i - 1) * f + f div 2 + 1 becomes i, size n div f."""
    out = labels
    for a, n in zip(IJK, dims):
        at = F.col(a) - 1 - factor // 2
        out = out.where((at >= 0) & (at % factor == 0) & (at / factor < n // factor))
    return out.withColumns({a: F.floor((F.col(a) - 1 - factor // 2) / factor).cast("int") + 1 for a in IJK})


def to_dense(sparse: DataFrame, dims: tuple, times: int, fill: float = 0.0) -> DataFrame:
    """Every (i, j, k, t_idx) of the grid, filled where there is a value."""
    cells = dims[0] * dims[1] * dims[2] * times
    n = F.col("id")
    ij = dims[0] * dims[1]
    full = sparse.sparkSession.range(cells).select(
        (n % dims[0] + 1).cast("int").alias("i"), (F.floor(n / dims[0]) % dims[1] + 1).cast("int").alias("j"),
        (F.floor(n / ij) % dims[2] + 1).cast("int").alias("k"), F.floor(n / (ij * dims[2])).cast("int").alias("t_idx"))
    return full.join(sparse.select(*IJK, "t_idx", "value"), [*IJK, "t_idx"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def roi_mean(values: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Mean over a cylinder around the middle axis, a tenth of the width in radius, in the middle half of the slices."""
    nx, ny, nz = dims
    r = max(2, nx // 10)
    di, dj = F.col("i") - nx // 2, F.col("j") - ny // 2
    inside = (di * di + dj * dj <= r * r) & F.col("k").between(max(1, nz // 4), min(nz, 3 * nz // 4))
    return values.where(inside).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def slice_table(values: DataFrame, keys: list[str], origin_z: float, thickness: float) -> DataFrame:
    """Per slice: smallest and largest pixel after rounding half to even and clipping to 16 bits, and its place."""
    pixel = F.least(F.greatest(F.bround("value"), F.lit(-32768)), F.lit(32767)).cast("int")
    return values.groupBy(*keys, "k").agg(F.min(pixel).alias("pixel_min"), F.max(pixel).alias("pixel_max")).withColumn(
        "z", origin_z + (F.col("k") - 1) * thickness)


def quantile_rank(total: Column, q: float) -> Column:
    """Nearest rank round(1 + q (n - 1)), half to even."""
    return F.bround(1 + q * (total - 1)).cast("bigint")


def display_range(values: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.995) -> DataFrame:
    """Display range by nearest ranks; falls back to min and max, then to one unit above."""
    from arborlake.plans.running import order_statistic

    qs = order_statistic(values, keys, "value", {
        "_lo": quantile_rank(F.col("total"), low), "_hi": quantile_rank(F.col("total"), high),
        "_min": F.lit(1), "_max": F.col("total")})
    wide = F.col("_hi") > F.col("_lo")
    lo = F.when(wide, F.col("_lo")).otherwise(F.col("_min"))
    hi = F.when(wide, F.col("_hi")).otherwise(F.col("_max"))
    return qs.select(*keys, lo.alias("low"), F.when(hi > lo, hi).otherwise(lo + 1).alias("high"))


_FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


BLOCK = 64  # cells along each axis of a block that one task labels by itself


def _local_components(cells: DataFrame, owner: str) -> DataFrame:
    """Adds ``cell`` and ``label``: the smallest cell code connected with a cell within its block of BLOCK^3 cells.

    Rows of one cell come once for each row that it has.
    """
    at = F.shiftleft(F.col("k").cast("long"), 42) + F.shiftleft(F.col("j").cast("long"), 21) + F.col("i")
    blocks = {f"_b{a}": F.floor(F.col(a) / BLOCK) for a in IJK}
    coded = cells.withColumn("cell", at.cast("long")).where(F.col("cell").isNotNull())
    schema = T.StructType([*coded.schema.fields, T.StructField("label", T.LongType())])

    def run(table):
        rows, inverse, times = np.unique(table.column("cell").to_numpy(), return_inverse=True, return_counts=True)
        kinds = table.column(owner).combine_chunks().dictionary_encode().indices
        kind = kinds.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(rows)
        owned = np.unique(kind[kind >= 0] * n + inverse[kind >= 0])  # (owner, cell) that exist
        ends = []
        for step in (1, 1 << 21, 1 << 42):
            ahead = rows[owned % n] + step
            to = np.minimum(np.searchsorted(rows, ahead), n - 1)
            there = owned // n * n + to
            found = np.minimum(np.searchsorted(owned, there), len(owned) - 1)
            hit = (rows[to] == ahead) & (owned[found] == there)
            ends.append((owned[hit] % n, to[hit]))
        a, b = (np.concatenate(x) for x in zip(*ends))
        root = np.arange(n)
        while len(a):
            x, y = root[a], root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        where = np.repeat(np.arange(len(inverse)), times[inverse])
        table = table.take(pa.array(where)).select(schema.names[:-1])
        return table.append_column("label", pa.array(rows[root[inverse[where]]]))

    return coded.withColumns(blocks).groupBy(*blocks).applyInArrow(run, schema)


def components(cells: DataFrame, owner: str = "owner") -> DataFrame:
    """Adds ``component``: the smallest cell code of the face-connected cells with the same owner.

    Blocks of cells are labelled each in one task; what is left is a graph of
    the labels that meet at faces between blocks.  Every round a label is
    joined to the smallest one next to it and then follows the labels one jump
    further, so long chains halve and rounds stay few.
    """
    state = cut(_local_components(cells, owner), "cells")
    own = [F.col(a) for a in IJK]
    high = reduce(Column.__or__, [F.pmod(c, F.lit(BLOCK)) == BLOCK - 1 for c in own])
    target = state.where(high).select(*IJK, F.col(owner).alias("_owner"), F.col("label").alias("to"))
    low = [state.where(F.pmod(c, F.lit(BLOCK)) == 0).select(*[(x - int(a == b)).cast(state.schema[b].dataType).alias(b) for b, x in zip(IJK, own)], owner, "label")
           for a, c in zip(IJK, own)]
    met = reduce(DataFrame.unionByName, low).join(target, IJK).where(F.col(owner) == F.col("_owner"))
    met = met.select(F.col("label").alias("cell"), "to").distinct()
    edges = cut(met.unionByName(met.select(F.col("to").alias("cell"), F.col("cell").alias("to"))), "edges")
    labels, tally = cut_counted(edges.select("cell", F.col("cell").alias("label")).distinct(), "labels", n=F.count("*"))
    n, n_edges = tally["n"], edges.count()
    while True:
        # Hook: labels of both ends of every edge between two components meet at the larger label.
        ends = lookup(edges, labels, ["cell"], n_edges).withColumnRenamed("label", "la").join(
            labels.select(F.col("cell").alias("to"), F.col("label").alias("lb")), "to").where("lb < la")
        lower = ends.groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("low"))
        lower, tally = cut_counted(lower, "hooks", n=F.count("*"))
        if tally["n"] == 0:
            break
        # Jump: a hooked label follows the label it was hooked to until it rests.
        while True:
            ahead = lower.select(F.col("label").alias("low"), F.col("low").alias("lower"))
            lower, moved = cut_counted(
                lookup(lower, lower.select("low").distinct().join(ahead, "low", "left"), ["low"], tally["n"]).select(
                    "label", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("_m")),
                "jumps", m=F.count_if("_m"))
            lower = lower.drop("_m")
            if moved["m"] == 0:
                break
        hooked = lookup(labels, labels.select("label").distinct().join(lower, "label", "left"), ["label"], n)
        labels = cut(hooked.select("cell", F.coalesce("low", "label").alias("label")), "labels")
    # Most labels keep themselves; the others are few beside the cells.
    moved = labels.where("cell <> label").select(F.col("cell").alias("label"), F.col("label").alias("component"))
    return state.join(moved, "label", "left").withColumn("component", F.coalesce("component", "label")).drop("cell", "label")


def clean_islands(cells: DataFrame, owner: str = "owner", min_voxels: int = 16) -> DataFrame:
    """Components below a size take the most frequent owner around them, the smallest owner on ties.

    All components are judged on the same snapshot.
    """
    labelled = cut(components(cells, owner), "components")
    sizes = labelled.groupBy("component").agg(F.count("*").alias("_n"))
    small = sizes.where(F.col("_n") < min_voxels).select("component")
    n = labelled.count()
    marked = lookup(labelled, sizes, ["component"], n)
    island = marked.where(F.col("_n") < min_voxels).select(*IJK, owner, "component")
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip(f, IJK)]) for f in _FACES]))
    asked = island.withColumn("_f", steps).withColumns({f"_{a}": F.col(a) + F.col(f"_f.{a}") for a in IJK})
    around = asked.select("component", owner, "_i", "_j", "_k").join(
        labelled.select(*[F.col(a).alias(f"_{a}") for a in IJK], F.col(owner).alias("_other")), ["_i", "_j", "_k"]
    ).where(F.col("_other") != F.col(owner))
    votes = around.groupBy("component", "_other").agg(F.count("*").alias("_c"))
    chosen = votes.groupBy("component").agg(F.min_by("_other", F.struct(-F.col("_c"), F.col("_other"))).alias("_new"))
    out = lookup(labelled, sizes.select("component").join(chosen, "component", "left"), ["component"], n)
    return out.withColumn(owner, F.coalesce("_new", owner)).drop("_new", "component")


def mixture(parts: DataFrame, composition: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Materials mixed by volume.

    ``parts`` is (keys, label, volume), ``composition`` is (label, density, z,
    fraction).  Returns element fractions (keys, z, fraction) and (keys, density,
    z_per_a, excitation_ev), all weighted by mass.
    """
    single = composition.groupBy("label").agg(F.first("density").alias("density")).join(
        electron_averages(composition, ["label"]), "label")
    weighed = parts.join(single, "label").withColumn("_m", F.col("volume") * F.col("density"))
    total = weighed.groupBy(*keys).agg(F.sum("_m").alias("_all"))
    shares = weighed.join(total, keys).withColumn("_w", F.col("_m") / F.col("_all"))
    elements = shares.select(*keys, "label", "_w").join(composition.select("label", "z", "fraction"), "label").groupBy(*keys, "z").agg(
        F.sum(F.col("_w") * F.col("fraction")).alias("fraction"))
    return elements, shares.groupBy(*keys).agg(
        *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in ("density", "z_per_a", "excitation_ev")])


def with_iodine(composition: DataFrame, mg_per_ml: Column) -> DataFrame:
    """Composition with iodine dissolved: (.., density, z, fraction) scaled, element 53 added."""
    iodine = mg_per_ml / 1000
    total = F.col("density") + iodine
    f = iodine / total
    base = composition.withColumns({"_f": f, "_t": total})
    scaled = base.withColumn("fraction", F.col("fraction") * (1 - F.col("_f")))
    others = [c for c in composition.columns if c not in ("z", "fraction")]
    extra = base.select(*others, F.lit(53).alias("z"), F.col("_f").alias("fraction"), "_t").distinct()
    both = scaled.select(*others, "z", "fraction", "_t").unionByName(extra)
    rest = [c for c in others if c != "density"]
    return both.groupBy(*rest, F.col("_t").alias("density"), "z").agg(F.sum("fraction").alias("fraction"))


# Atomic mass and mean excitation energy (eV) by atomic number.
ATOMIC_MASS = {1: 1.008, 6: 12.011, 7: 14.007, 8: 15.999, 11: 22.990, 12: 24.305, 15: 30.974, 16: 32.06,
               17: 35.45, 19: 39.098, 20: 40.078, 26: 55.845, 53: 126.904}
EXCITATION_EV = {1: 19.2, 6: 81.0, 7: 82.0, 8: 95.0, 11: 149.0, 12: 156.0, 15: 173.0, 16: 180.0, 17: 174.0,
                 19: 190.0, 20: 191.0, 26: 286.0, 53: 491.0}


def _by_z(table: dict[int, float], z: Column, fallback: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, z.cast("int")), fallback)


def electron_averages(composition: DataFrame, keys: list[str]) -> DataFrame:
    """Z/A ratio and mean excitation energy of a composition (keys, z, fraction)."""
    z = F.col("z").cast("double")
    a = _by_z(ATOMIC_MASS, F.col("z"), z * 2)
    i = _by_z(EXCITATION_EV, F.col("z"), z * 10)
    za = F.col("fraction") * z / a
    return composition.groupBy(*keys).agg(
        (F.sum(za) / F.sum(F.col("fraction") / a)).alias("z_per_a"), F.exp(F.sum(za * F.log(i)) / F.sum(za)).alias("excitation_ev"))
