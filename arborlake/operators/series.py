"""Time series per segment: input curves, delays, bounded running sums and summaries.

A series is either long, one row per (tree, id, t_idx), or wide, one array per
segment; ``t_idx`` starts at 0.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.operators import trees
from arborlake.plans.cut import cut
from arborlake.plans.packed import met_by_index, packed, unpacked
from arborlake.plans.running import as_of
from arborlake.plans.runs import by_level, single_runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["tree", "id"]


def time_table(df: DataFrame, n: int, t0: float, dt: float) -> DataFrame:
    """Every row of ``df`` once per time."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return df.withColumn("t_idx", i).withColumn("t", t0 + F.col("t_idx") * dt)


def uniform_step(series: DataFrame, keys: list[str], rtol: float = 1e-8, atol: float = 1e-12) -> DataFrame:
    """(keys, n, dt, uniform): are all steps positive and equal to the first one?

    The step before a row is found by its index, so a long series is not sorted in one task.
    """
    before = met_by_index(series.select(*keys, "t_idx", "t"), keys, "t_idx", {"_before": (F.col("t_idx") - 1, "t")})
    stepped = before.withColumn("_step", F.col("t") - F.col("_before"))
    out = stepped.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("t_idx") == 1, F.col("_step"))).alias("dt"),
        F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    off = F.greatest(F.abs(F.col("_lo") - F.col("dt")), F.abs(F.col("_hi") - F.col("dt")))
    ok = (F.col("n") >= 2) & (F.col("_lo") > 0) & (off <= F.greatest(F.lit(atol), rtol * F.abs("dt")))
    return out.select(*keys, "n", "dt", F.coalesce(ok, F.lit(False)).alias("uniform"))


def nearest_sample(asked: DataFrame, samples: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Value at the sample time nearest to the asked one, the earlier on ties."""
    met = as_of(asked, samples, keys, time, value)
    back, ahead = F.col(time) - F.col("prev_t"), F.col("next_t") - F.col(time)
    take = F.col("next_t").isNull() | (F.col("prev_t").isNotNull() & (back <= ahead))
    return met.withColumns({
        "near_t": F.when(take, F.col("prev_t")).otherwise(F.col("next_t")),
        "near_v": F.when(take, F.col("prev_v")).otherwise(F.col("next_v")),
    }).drop("prev_t", "prev_v", "next_t", "next_v")


def interpolated(asked: DataFrame, samples: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Linear blend of the samples around the asked time; 0 before the first, the last one after the end."""
    met = as_of(asked, samples, keys, time, value)
    w = (F.col(time) - F.col("prev_t")) / (F.col("next_t") - F.col("prev_t"))
    blend = (1 - w) * F.col("prev_v") + w * F.col("next_v")
    out = F.when(F.col("prev_t").isNull(), F.lit(0.0)).when(F.col("next_t").isNull(), F.col("prev_v")).otherwise(blend)
    return met.withColumn("value", out).drop("prev_t", "prev_v", "next_t", "next_v")


def delayed(series: DataFrame, keys: list[str], delay: Column, t0: float, dt: float) -> DataFrame:
    """Value of the own series ``delay`` ago on a uniform time axis: blend of two samples met by index."""
    pos = (F.col("t") - delay - t0) / dt
    asked = series.withColumns({"_pos": pos, "_lo": F.floor(pos), "_hi": F.least(F.ceil(pos), F.col("t_idx").cast("bigint"))})
    met = met_by_index(asked, keys, "t_idx", {"_vlo": (F.col("_lo"), "value"), "_vhi": (F.col("_hi"), "value")})
    w = F.col("_pos") - F.col("_lo")
    out = F.when(F.col("_pos") < 0, F.lit(0.0)).otherwise((1 - w) * F.col("_vlo") + w * F.col("_vhi"))
    return met.withColumn("delayed", out).drop("_pos", "_lo", "_hi", "_vlo", "_vhi")


def bounded_running_sum(series: DataFrame, keys: list[str], rate: Column, dt: float) -> DataFrame:
    """C(0) = 0 and C(t) = max(C(t - 1) + dt * rate(t - 1), 0), in closed form.

    With S the running sum of the steps, C is S minus the smallest S so far.  A
    series holds one row per time, so one key is one bounded window.
    """
    w = Window.partitionBy(*keys).orderBy("t_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    stepped = series.withColumn("_d", F.coalesce(F.lag(dt * rate).over(w), F.lit(0.0)))
    summed = stepped.withColumn("_s", F.sum("_d").over(upto))
    return summed.withColumn("bounded", F.col("_s") - F.min("_s").over(upto)).drop("_d", "_s")


CELLS = 2_000_000  # samples that one step of a batch looks at together


def _later(history: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Each row of a matrix of histories ``shift`` samples ago: blended, 0 before the start, never past the present."""
    now = np.arange(history.shape[1])
    pos = now - shift[:, None]
    lo, hi = np.floor(pos).astype(np.int64), np.ceil(pos).astype(np.int64)
    at = lambda i: np.take_along_axis(history, np.clip(i, 0, len(now) - 1), 1)
    w = pos - lo
    blend = np.where(w == 0, at(lo), (1 - w) * at(lo) + w * at(hi))
    return np.where(pos < 0, 0.0, np.where(hi > now, history, blend))


def _content(inlet: np.ndarray, outlet: np.ndarray, tau: np.ndarray, dt: float) -> np.ndarray:
    """Bounded running sum of what comes in less what goes out: the sum less its smallest value so far."""
    steps = np.zeros_like(inlet)
    steps[:, 1:] = dt * (inlet - outlet)[:, :-1] / tau[:, None]
    total = np.cumsum(steps, axis=1)
    return total - np.minimum.accumulate(total, axis=1)


_SERIES = ("inlet", "outlet", "content")


def _through_runs(dt: float):
    """Arrow mapper: runs (ids, taus in order, inlet of the first) to the series of all their rows."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = pc.list_value_length(table.column("inlet")).to_numpy().astype(np.int64)
            for width in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == width)
                step = max(1, CELLS // max(width, 1))
                for lo in range(0, len(rows), step):
                    yield from _one(table.take(pa.array(rows[lo : lo + step])), width)

    def _one(part: pa.Table, width: int):
        now = part.column("inlet").combine_chunks().flatten().to_numpy().reshape(-1, width)
        taus = part.column("taus").combine_chunks()
        start = np.asarray(taus.offsets, np.int64)
        values = taus.values.to_numpy(zero_copy_only=False)
        ids = part.column("ids").combine_chunks().values.to_numpy()
        size = np.diff(start)
        left = np.arange(len(size))
        for k in range(int(size.max(initial=0))):
            go = size[left] > k
            left, now = left[go], now[go]
            tau = values[start[left] + k]
            out = _later(now, tau / dt)
            series = (now, out, _content(now, out, tau, dt))
            offsets = pa.array(np.arange(len(left) + 1) * width, pa.int32())
            keys = [part.column(c).combine_chunks().take(pa.array(left)) for c in ("tree", "run", "piece")]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel())) for x in series]
            yield from pa.table([*keys, pa.array(ids[start[left] + k]), pa.array(size[left] == k + 1), pa.array(tau), *lists],
                                names=["tree", "run", "piece", "id", "ends", "tau", *_SERIES]).to_batches()
            now = out

    return run


def delay_propagation(segs: DataFrame, tau: Column, inputs: DataFrame, dt: float) -> DataFrame:
    """Series of every segment: inlet, outlet and mean content as arrays.

    ``inputs`` is (tree, curve), one array per tree.  The outlet is the inlet
    ``tau`` ago, the inlet is the parent's outlet.  A run of single children is one
    row that a task takes through all its delays in order, so there is one step
    per branching level: the runs of one level of all trees meet the last outlets
    of the level above.
    """
    missing = segs.select("tree").distinct().join(inputs.select("tree"), "tree", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"no input curve for {[r[0] for r in missing.take(5)]}")
    rows, levels = single_runs(segs.withColumn("tau", tau.cast("double")), ["tau"])
    pieces = by_level(rows.groupBy("tree", "run", "piece", "up_run", "up_piece", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "tau"))).alias("m")).select(
        "tree", "run", "piece", "up_run", "up_piece", "level", F.col("m.id").alias("ids"), F.col("m.tau").alias("taus")))
    made = f"tree string, run long, piece int, id long, ends boolean, tau double, {', '.join(f'{c} array<double>' for c in _SERIES)}"
    out, above = None, None
    for level in range(levels):
        here = pieces.where(F.col("level") == level)
        if above is None:
            met = here.join(inputs.select("tree", F.col("curve").cast("array<double>").alias("inlet")), "tree")
        else:
            met = here.join(above, ["tree", "up_run", "up_piece"])
        done = cut(met.select("tree", "run", "piece", "ids", "taus", "inlet").mapInArrow(_through_runs(dt), made), "outlets")
        above = done.where("ends").select("tree", F.col("run").alias("up_run"), F.col("piece").alias("up_piece"), F.col("outlet").alias("inlet"))
        part = done.select(*KEY, "tau", *_SERIES)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return segs.sparkSession.createDataFrame([], f"tree string, id long, tau double, {', '.join(f'{c} array<double>' for c in _SERIES)}")
    return out


def long_form(wide: DataFrame, keys: list[str], cols: list[str], t0: float, dt: float) -> DataFrame:
    """One row per time of arrays of equal length."""
    zipped = F.arrays_zip(*cols)
    out = wide.select(*keys, F.posexplode(zipped).alias("t_idx", "_z"))
    return out.select(*keys, "t_idx", (t0 + F.col("t_idx") * dt).alias("t"), *[F.col(f"_z.{c}").alias(c) for c in cols])


def path_delay_series(segs: DataFrame, tau: Column, curve: Column) -> DataFrame:
    """Fast form: the root curve (a Column of ``since``, the delay of the way down) without blending at every level."""
    way = trees.path_sums(segs, {"since": tau})
    return way.withColumn("value", curve)


def summary(series: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Peak, time of the peak and first time above a threshold (infinite when never) per series."""
    over = F.when(F.col("value") > threshold, F.col("t"))
    return series.groupBy(*keys).agg(
        F.max("value").alias("peak"), F.max_by("t", F.struct("value", -F.col("t"))).alias("peak_t"),
        F.coalesce(F.min(over), F.lit(float("inf"))).alias("first_t"), F.count_if(F.col("value") > threshold).alias("n_above"))


def segment_mass(series: DataFrame, volumes: DataFrame) -> DataFrame:
    """Content times volume per segment and time; the series travel packed."""
    arrays = [c for c in series.columns if c not in KEY]
    met = unpacked(packed(series, KEY).join(volumes, KEY), arrays)
    return met.select(*KEY, *arrays, *[c for c in volumes.columns if c not in KEY]).withColumn("mass_mg", F.col("value") * F.col("volume_ml"))


def every_nth(series: DataFrame, stride: int) -> DataFrame:
    return series.where(F.col("t_idx") % stride == 0)
