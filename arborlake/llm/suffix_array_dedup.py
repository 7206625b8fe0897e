"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Suffixes that can matter are those at anchors that stand in different surroundings (see ``repeats``); the rest is
decided by whole stretches.  They are range-partitioned by their leading bytes with splitters that Spark samples; a
leading string with more than ``EACH`` suffixes is cut further, by document, so it can lie in several buckets.  Each
bucket sorts the windows around its suffixes by multikey quicksort, eight bytes at a time: runs of equal windows are
left, and all but the first place of a run are removed.  The windows of leading strings that were cut are compared
across the boundaries of their buckets, by the first place that each bucket has for each.

Defined cases: a null text has no bytes; texts shorter than the window lose nothing; rows that repeat id and text are
one document and get equal results; of rows with one id and different texts the one with the smaller hash of its text
comes first; null ids come before others.  Extra columns pass through; the added ones (n_bytes, n_removed, n_spans,
kept) replace columns of those names.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm.common import cut, ships, span_hashes, table, tasks, text_buffers
from arborlake.llm.repeats import _BYTES, Kind, covered, finished, identified, marks, refined, runs_of, stretches

ships(__name__)

BYTES = Kind(window=100, gram=40, blanks=None, later=True)
LEAD = 16
EACH = 40_000  # suffixes of one bucket, on average, and of one leading string that is not cut
AT_ONCE = 400_000  # windows that are sorted together, unless one leading string has more
_RUNS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("runs", pa.list_(pa.binary())), ("bucket", pa.int64()), ("lead", pa.binary()),
                   ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64())])
_DDL = "id bigint, h bigint, runs array<binary>, bucket bigint, lead binary, k1 bigint, k2 bigint, at bigint"


def windows_of(rows: list[tuple], width: int, unit: int, window: int):
    """Windows of (lead number, id, h, at, off, symbols) rows: place in the joined symbols, group, id, h, start."""
    lead, ids, hs, at, off = (np.array(x, np.int64) for x in list(zip(*rows))[:5])
    size = np.array([len(r[5]) // unit for r in rows])
    n = size - window + 1
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    which = np.repeat(np.arange(len(rows)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    before = off[which] - step  # of the anchor, equal for equal windows
    return base[which] + step, lead[which] * width + before, ids[which], hs[which], at[which] + step


def sorted_runs(rows: list[tuple]):
    """Places that are not the first of their run of equal windows; and all first places with two hashes of the window."""
    where, group, ids, hs, at = windows_of(rows, 1024, 1, BYTES.window)
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    m = len(data) - 7
    token = np.zeros(m, np.uint64)
    for k in range(8):
        token = token << np.uint64(8) | data[k : k + m]
    at_round = lambda base, t: token[base + min(8 * t, BYTES.window - 8)]
    _, group = np.unique(group, return_inverse=True)
    who, run = refined(where, group, at_round, -(-BYTES.window // 8))
    order = np.lexsort((at[who], hs[who], ids[who], run))
    who, run = who[order], run[order]
    later = np.zeros(len(who), bool)
    later[1:] = run[1:] == run[:-1]
    # A place can come twice where a task read a document again: it is no later place of itself.
    same = later.copy()
    same[1:] &= (ids[who][1:] == ids[who][:-1]) & (hs[who][1:] == hs[who][:-1]) & (at[who][1:] == at[who][:-1])
    gone = who[later & ~same]
    first = np.ones(len(where), bool)
    first[who[later]] = False
    return runs_of(ids[gone], hs[gone], at[gone]), (where, first, ids, hs, at, data)


def bucket_sort(suffixes: DataFrame) -> DataFrame:
    """Repeated places of each bucket, and the first places of the leading strings that are cut."""

    def solved(rows, wide, names, bucket):
        runs, (where, first, ids, hs, at, data) = sorted_runs(rows)
        for a in range(0, len(runs), 2_000):
            yield pa.RecordBatch.from_pylist([{"id": i, "h": h, "runs": r} for i, h, r in runs[a : a + 2_000]], _RUNS)
        number = np.repeat(np.array([r[0] for r in rows]), [len(r[5]) - BYTES.window + 1 for r in rows])
        pick = np.flatnonzero(first & np.isin(number, wide))
        if len(pick):
            k1 = span_hashes(_BYTES[data], where[pick], where[pick] + BYTES.window)
            k2 = span_hashes(_BYTES[255 - data], where[pick], where[pick] + BYTES.window)
            none = pa.nulls(len(pick), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[pick]), pa.array(hs[pick]), none, pa.array(np.full(len(pick), bucket)), pa.array([names[i] for i in number[pick].tolist()], pa.binary()),
                pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)), pa.array(at[pick])], schema=_RUNS)

    def run(batches):
        bucket = TaskContext.get().partitionId()
        rows, held, names, wide = [], 0, [], []
        for batch in batches:
            for i, h, at, off, symbols, lead, many in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "at", "off", "symbols", "lead", "many"))):
                if not names or names[-1] != lead:
                    if held >= AT_ONCE:
                        yield from solved(rows, wide, names, bucket)
                        rows, held, names, wide = [], 0, [], []
                    names.append(lead)
                    if many:
                        wide.append(len(names) - 1)
                rows.append((len(names) - 1, i, h, at, off, symbols))
                held += len(symbols) - BYTES.window + 1
        if rows:
            yield from solved(rows, wide, names, bucket)

    n = max(tasks(suffixes.sparkSession), suffixes.count() // EACH)
    # At most one in EACH suffixes names such a string.
    many = suffixes.groupBy("lead").count().where(F.col("count") > EACH).select("lead", F.lit(True).alias("many"))
    marked = suffixes.join(F.broadcast(many), "lead", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    dealt = marked.repartitionByRange(n, "lead", F.when(F.col("many"), F.col("id"))).sortWithinPartitions("lead")
    return cut(dealt.mapInArrow(run, _DDL), "buckets")


def across(found: DataFrame) -> DataFrame:
    """Repeated places that only show across the boundary of buckets."""
    edges = found.where("bucket IS NOT NULL").drop("runs")
    wide = edges.groupBy("lead").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a < b").select("lead")
    edges = edges.join(wide, "lead")
    first = edges.groupBy("lead", "k1", "k2").agg(F.min(F.struct("id", "h", "at")).alias("first"))
    later = edges.join(first, ["lead", "k1", "k2"]).where(F.struct("id", "h", "at") != F.col("first")).select("id", "h", "at")

    def run(batches):
        for batch in batches:
            runs = runs_of(*(batch.column(c).to_numpy() for c in ("id", "h", "at")))
            yield pa.RecordBatch.from_pylist([{"id": i, "h": h, "runs": r} for i, h, r in runs], pa.schema(list(_RUNS)[:3]))

    return later.mapInArrow(run, "id bigint, h bigint, runs array<binary>")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep``, kept: the bytes that stay."""
    named = identified(docs, id, text)
    places = marks(named, BYTES)
    suffixes = cut(stretches(named, places, BYTES).withColumn("lead", F.substring("symbols", F.col("off").cast("int") + 1, F.lit(LEAD))), "suffixes")
    found = bucket_sort(suffixes)
    decided = places.where(F.size("done") > 0).select("id", "h", F.col("done").alias("runs"))

    def work(part):
        data, offsets = text_buffers(part.column(text))
        gone = covered(offsets, part.column("_runs").to_pylist(), BYTES)
        spans, shas, kept = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            g = gone[a:b]
            stays = data[a:b][~g].tobytes()
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            shas.append(hashlib.sha256(stays).hexdigest())
            kept.append(stays)
        total = np.concatenate([[0], np.cumsum(gone)])
        out = [pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(spans, pa.int64()), pa.array(shas)]
        return out + [pa.array(kept, pa.binary())] * keep

    added = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep
    return finished(docs, id, text, [decided, found.where("bucket IS NULL").select("id", "h", "runs"), across(found)], BYTES, added, work)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
