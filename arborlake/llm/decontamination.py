"""Benchmark decontamination by winnowing.

Texts become sequences of word hashes.  Of the six 5-word hashes inside each 10-word window the smallest is kept as
the window's fingerprint (robust under shifts: neighbouring windows mostly share it), so every shared span of ten
words yields a fingerprint on both sides that agrees.  Document fingerprints meet those of the benchmark; where one
agrees, the hit is extended: the whole window is compared, first by hash, then word by word.  A benchmark item of
fewer words is one window of its own length and is looked up as such.

The benchmark is a stated query set.  Repeated rows count once, long items go in pieces that overlap by nine words, and
pieces are dealt by their running size into blocks of at most ``BLOCK_BYTES`` of text (more only where ten words are
longer); each block is broadcast and meets all documents in one pass, so its memory is bounded and a larger benchmark
takes more passes.  Documents are never shuffled: one with very many hits is its own row's work.

Defined cases: a null text has no words; an item without words is in no document; items of one id are one item; an
item whose id is null marks words but is not listed.  Extra columns pass through; the added ones (n_words, hits,
items) replace columns of those names.  A text is held in memory as a whole, about 30 bytes for each of its bytes.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from arborlake.llm.common import byte_class, byte_symbols, cut, ships, slices, span_hashes, table, text_buffers, with_columns_of_text, words_of

ships(__name__)

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 2 << 20
_INSIDE = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
_SYMBOLS = byte_symbols(8, fold=True)
_FILTER_BITS = 22  # at most; 16 places for each hash of a smaller block


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    starts, ends, rows = words_of(data, offsets, _INSIDE)
    return starts, ends, rows, span_hashes(_SYMBOLS[data], starts, ends)


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``size`` words that lie in one row, and their hashes."""
    at = np.arange(len(hashes) - size + 1) if len(hashes) >= size else np.zeros(0, np.int64)
    last = np.repeat(rows[1:], np.diff(rows))
    at = at[at + size <= last[at]]
    return at, span_hashes(hashes, at, at + size)


def fingerprints(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the 10-word windows and the smallest of the 5-word hashes in each."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - GRAM + 1)
    grams = span_hashes(hashes, at, at + GRAM)
    n = len(hashes) - WINDOW + 1
    least = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[j : j + n], out=least)
    last = np.repeat(rows[1:], np.diff(rows))
    starts = np.flatnonzero(np.arange(n) + WINDOW <= last[:n])
    return starts, least[starts]


def tables(items: list[tuple]) -> dict:
    """Of one block of (id, text) items: words of each window to ids, window hashes by size, fingerprints, bit filters."""
    ids = [None if i is None else str(i) for i, _ in items]
    data, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
    starts, ends, rows, hashes = word_hashes(data, offsets)
    of = np.repeat(np.arange(len(ids)), np.diff(rows))
    raw = data.tobytes().lower()
    known: dict[bytes, set] = {}
    by_size: dict[int, np.ndarray] = {}
    size_of_item = np.diff(rows)[of] if len(of) else of
    for size in range(1, WINDOW + 1):
        at, h = windows(hashes, rows, size)
        if size < WINDOW:
            keep = size_of_item[at] == size
            at, h = at[keep], h[keep]
        for s in at:
            known.setdefault(b" ".join(raw[a:b] for a, b in zip(starts[s : s + size], ends[s : s + size])), set()).add(ids[of[s]])
        if len(h):
            by_size[size] = np.unique(h)
    prints = np.unique(fingerprints(hashes, rows)[1])
    return {"items": known, "hashes": by_size, "prints": prints, "bits": {0: _bits(prints)} | {k: _bits(v) for k, v in by_size.items()}}


def candidates(block: dict, hashes: np.ndarray, rows: np.ndarray):
    """(size, starts) of the windows of documents whose hash a window of the block has."""
    for size, known in block["hashes"].items():
        if size == WINDOW:
            at, prints = fingerprints(hashes, rows)
            at = at[_within(prints, block["prints"], block["bits"][0])]
            h = span_hashes(hashes, at, at + WINDOW) if len(at) else at.astype(np.uint64)
        else:
            at, h = windows(hashes, rows, size)
        yield size, at[_within(h, known, block["bits"][size])]


def _bits(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << min(_FILTER_BITS, max(10, (16 * len(values)).bit_length())), bool)
    out[(values & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def _within(h: np.ndarray, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, h[some]), len(known) - 1)
    out[some] = known[at] == h[some]
    return out


def _search(part: pa.RecordBatch, text: str, block: dict | None) -> list[pa.Array]:
    data, offsets = text_buffers(part.column(text))
    starts, ends, rows, hashes = word_hashes(data, offsets)
    n = part.num_rows
    marked = np.zeros(len(starts) + 1, bool)
    items: list[set] = [set() for _ in range(n)]
    names = part.schema.names
    if "hits" in names:  # of the blocks before
        for r, (spans, got) in enumerate(zip(part.column("hits").to_pylist(), part.column("items").to_pylist())):
            items[r] |= set(got)
            for x in spans:
                marked[rows[r] + x["start"] : rows[r] + x["end"]] = True
    if block is not None:
        raw = data.tobytes().lower()
        for size, at in candidates(block, hashes, rows):
            of = np.searchsorted(rows, at, "right") - 1
            for s, r in zip(at.tolist(), of.tolist()):
                found = block["items"].get(b" ".join(raw[a:b] for a, b in zip(starts[s : s + size].tolist(), ends[s : s + size].tolist())))
                if found:
                    marked[s : s + size] = True
                    items[r] |= found
    inner = marked[:-1]
    edge = np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8))
    first = rows[:-1][rows[:-1] < len(inner)]
    cut = first[(first > 0) & inner[first] & inner[first - 1]] if len(inner) else first  # spans end with their row
    opens = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.unique(cut)]))
    closes = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.unique(cut)]))
    of = np.searchsorted(rows, opens, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(opens - rows[of], pa.int64()), pa.array(closes - rows[of], pa.int64())], ["start", "end"])
    bounds = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return [
        pa.array(np.diff(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), spans),
        pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string()))]


def pieces(text: str, room: int) -> list[str]:
    """The text, or if it is longer than ``room`` bytes its words in pieces that overlap by nine; no window is lost."""
    raw = text.encode()
    if len(raw) <= room:
        return [text]
    starts, ends, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _INSIDE)
    upto, n = np.cumsum(ends - starts + 1), len(starts)
    out, at, end = [], 0, 0
    while end < n:
        end = min(n, max(at + WINDOW, int(np.searchsorted(upto, room + (upto[at - 1] if at else 0), "right"))))
        out.append(b" ".join(raw[a:b] for a, b in zip(starts[at:end].tolist(), ends[at:end].tolist())).decode())
        at = end - WINDOW + 1
    return out


def blocked(benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """(item_id, text, block): pieces of the distinct items; each task fills its own blocks up to their size."""
    bench = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    room = max(1, block_bytes // 2)

    def run(batches):
        task, block, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text").to_pylist()):
                for piece in pieces(text, room):
                    size = len(piece.encode())
                    if held and held + size > block_bytes:
                        block, held = block + 1, 0
                    held += size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()], item.type), pa.array([piece]), pa.array([f"{task}-{block}"])], ["item_id", "text", "block"])

    # About 16 blocks for each task, so few blocks are left part filled.  Items go round by number, not by key: a session
    # that raises the parts of keyed shuffles would make a broadcast block for each.
    dealt = bench.repartition(1 + total // (16 * block_bytes))
    return cut(dealt.mapInArrow(run, StructType([*bench.schema.fields, StructField("block", StringType())])), "benchmark")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, hits (merged spans of hit words, start and end in words) and items (ids with occurring windows)."""
    spark = docs.sparkSession
    bench = blocked(benchmark, block_bytes)
    blocks = [r.block for r in bench.select("block").distinct().orderBy("block").collect()] or [None]
    out = docs.drop("n_words", "hits", "items")
    for i, block in enumerate(blocks):
        rows = [] if block is None else bench.where(F.col("block") == block).select("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(tables([tuple(r) for r in rows]) if rows else None)
        out = with_columns_of_text(
            out, "n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>",
            _searcher(sent, text), text) if i == 0 else _again(out, sent, text)
    return out


def _searcher(sent, text):
    return lambda part: _search(part, text, sent.value)


def _again(out: DataFrame, sent, text: str) -> DataFrame:
    """A further block over rows that have the hits of earlier ones."""
    schema = out.schema
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                new = dict(zip(("n_words", "hits", "items"), _search(part, text, sent.value)))
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names=names)

    return out.mapInArrow(run, schema)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH itext AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
iword AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM itext),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
   FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM iword WHERE len(w) > 0)),
size AS (SELECT DISTINCT size FROM win),
dword AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dwin AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS key
   FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM dword, size WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, i, size FROM dwin JOIN win USING (size, key)),
n_hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS at FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items,
   sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM dword LEFT JOIN n_hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""
