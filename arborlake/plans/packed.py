"""Long series as packed rows: consecutive rows of one key travel as one row of arrays.

Spark sizes a long series by the table it was exploded from, so a plain join takes it for small, broadcasts it, or else
shuffles every sample with its key.  Packed, a key is sent once for each run of its rows and arrays compress well.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 65_536  # indices of a series that is met as one row; longer ones are joined by (keys, index)
CELLS = 500_000  # samples that one step of a batch looks at together


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, and an array of each other column, one row for each run of rows that agree in their keys.

    A run ends with its Arrow batch, so one key may have several rows; nothing is shuffled or held.
    """
    rest = [c for c in rows.columns if c not in keys]
    shaped = rows.select(*keys, *rest)
    schema = T.StructType([*[shaped.schema[k] for k in keys], *[T.StructField(c, T.ArrayType(shaped.schema[c].dataType)) for c in rest]])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in keys]))
            starts = pa.array(np.concatenate([[0], ends[:-1]]))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(starts) for k in keys], *[pa.ListArray.from_arrays(offsets, batch.column(c)) for c in rest]],
                names=[*keys, *rest])

    return shaped.mapInArrow(run, schema)


def unpacked(runs: DataFrame, arrays: list[str]) -> DataFrame:
    """One row per element of the arrays, which have one length in a row; they come after the other columns."""
    others = [c for c in runs.columns if c not in arrays]
    return runs.select(*others, F.inline(F.arrays_zip(*arrays)))


def met_by_index(series: DataFrame, keys: list[str], index: str, asked: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds, by name, the value column of the own series at an asked index; null where there is none.

    As with left joins by (keys, index), a row comes once for each row that it meets, and null keys or indices meet
    nothing.  Series of up to ``LONGEST`` indices are gathered once, packed, and met inside their row.
    """
    low, high = series.agg(F.min(index), F.max(index)).first()
    asks = {f"_ask_{n}": at.cast("bigint") for n, (at, _) in asked.items()}
    rows = series.withColumns(asks)
    if low is not None and high - low >= LONGEST:
        for n, (_, value) in asked.items():
            other = series.select(*keys, F.col(index).cast("bigint").alias(f"_ask_{n}"), F.col(value).alias(n))
            rows = rows.join(other.hint("merge"), [*keys, f"_ask_{n}"], "left")
        return rows.select(*series.columns, *asked)
    rest = [c for c in rows.columns if c not in keys]
    runs = packed(rows, keys)
    whole = runs.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_m")).select(*keys, *[F.flatten(F.col(f"_m.{c}")).alias(c) for c in rest])
    kept = [c for c in series.columns]
    schema = T.StructType([*series.schema.fields, *[T.StructField(n, series.schema[v].dataType) for n, (_, v) in asked.items()]])
    values = {n: v for n, (_, v) in asked.items()}

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(index)).to_numpy()
            upto, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, CELLS + (upto[at - 1] if at else 0), "right")))
                yield _meet(batch.slice(at, to - at), keys, index, kept, values)
                at = to

    return whole.mapInArrow(run, schema)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Integers of a column and which of them are there."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(column).to_numpy(zero_copy_only=False)


def _meet(part: pa.RecordBatch, keys: list[str], index: str, kept: list[str], values: dict[str, str]) -> pa.RecordBatch:
    of = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(index)).to_numpy())
    flat = {c: part.column(c).flatten() for c in part.schema.names if c not in keys}
    keyed = np.ones(part.num_rows, bool)
    for k in keys:
        keyed &= pc.is_valid(part.column(k)).to_numpy(zero_copy_only=False)
    at, there = _numbers(flat[index])
    there &= keyed[of]
    known = np.unique(at[there])
    place = of * (len(known) + 1) + np.searchsorted(known, at)
    samples = np.flatnonzero(there)
    samples = samples[np.argsort(place[samples], kind="stable")]
    sorted_places = place[samples]
    rows, hits = np.arange(len(of)), {}
    for name in values:
        ask, asks = _numbers(flat[f"_ask_{name}"])
        rank = np.searchsorted(known, ask)
        asks &= keyed[of]
        asks[asks] = np.append(known, 0)[rank[asks]] == ask[asks]
        asks &= rank < len(known)
        want = of * (len(known) + 1) + rank
        first = np.searchsorted(sorted_places, want, "left")
        n = np.where(asks, np.searchsorted(sorted_places, want, "right") - first, 0)
        times = np.maximum(n, 1)[rows]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows = np.repeat(rows, times)
        hits = {k: np.repeat(v, times) for k, v in hits.items()}
        found = n[rows] > 0
        hit = np.full(len(rows), -1)
        hit[found] = samples[(first[rows] + nth)[found]]
        hits[name] = hit
    out = [part.column(c).take(pa.array(of[rows])) if c in keys else flat[c].take(pa.array(rows)) for c in kept]
    out += [flat[v].take(pa.array(hits[n], mask=hits[n] < 0)) for n, v in values.items()]
    return pa.RecordBatch.from_arrays(out, names=[*kept, *values])
