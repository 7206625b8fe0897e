"""Packing by concatenating and cutting: all token ids as one line, cut into windows of fixed length.

Two passes.  ``encoded`` tokenizes and writes each text's ids with the ids before it in its task; a task's total is the
end of its last text.  Prefix sums over these totals (one number a task, so their size is bounded by the tasks) give
every id its global place.  ``packed`` reads the ids back and cuts each text where a window ends.  No row is shuffled and
every window but the last is full, so padding is below one window for the whole corpus.

``windows`` puts the pieces together.  A window that lies within one task's run of rows is made there; one that goes
over the end of a run comes as boundary records, at most two a run, which meet by window number.

Byte-level BPE never joins characters across the start of a run of blanks, nor a letter with the punctuation behind it,
so texts are cut there into units and a task encodes a distinct unit once; equal hashes are compared byte by byte, so the ids are exact.

Defined cases: a null text is an empty one, and an empty text is its end id alone.  Rows with equal or null keys are
texts of their own.  Other columns of ``docs`` are not looked at.  An empty table gives no pieces.  One text is handled
whole, at some 40 times its bytes.
"""

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm.common import Spans, byte_symbols, cut, ships, slices, table, text_buffers

ships(__name__)

LENGTH, END = 2048, 1
BLOCK = 1 << 22  # bytes of text looked at together
KNOWN = 500_000  # units that a task remembers, at some 200 bytes each


def vocabulary() -> str:
    """Path of the public byte-level vocabulary; PACKING_TOKENIZER names another one."""
    if path := os.environ.get("PACKING_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of many texts at once by a tokenizers file, each distinct unit encoded once."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_unit = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) \
            and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in added)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.symbols = byte_symbols(11)
        kinds = np.zeros(256, np.uint8)
        kinds[list(b" \t\n\x0b\f\r")] = 1
        kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 2
        kinds[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = 4
        for t in added:  # punctuation of an added token may be inside it
            kinds[[b for b in t["content"].encode() if kinds[b] == 4]] = 8
        self.kinds = kinds
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.base, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, parts: list[bytes]) -> None:
        """Ids of new units, behind those of the known ones."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.base = np.concatenate([self.base, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum()))])
        self.sizes = np.concatenate([self.sizes, sizes])

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the units: of each text, of each run of ASCII blanks after what is surely no blank, and of
        punctuation (no apostrophe) after a letter."""
        kind = self.kinds[data]
        cut_at = np.zeros(len(data), bool)
        latin = np.zeros(len(data), bool)  # second bytes of the letters U+00C0 to U+00FF
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter = (kind == 2) | latin
        sure = letter | (kind >= 4) | ((data >= 0x30) & (data < 0x3A))
        cut_at[1:] = (kind[1:] == 1) & sure[:-1] | (kind[1:] == 4) & letter[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        cut_at[first] = True
        return np.flatnonzero(cut_at)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` one after the other, and the texts' offsets among them."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        starts = self._units(data, offsets) if self.by_unit else offsets[:-1][np.diff(offsets) > 0]
        ends = np.append(starts[1:], len(data))
        hashes = Spans(self.symbols[data]).hashes(starts, ends)
        _, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = ends - starts
        same = np.array_equal(sizes, sizes[first][unit])
        if same:  # byte for byte
            shift = np.repeat(starts[first][unit] - starts, sizes)
            same = np.array_equal(data, data[np.arange(len(data)) + shift])
        if not same:  # two units share a hash: each place for itself
            first, unit = np.arange(len(starts)), np.arange(len(starts))
        parts = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        if len(self.known) + len(new) > KNOWN and self.known:
            self._forget()
            new = list(dict.fromkeys(parts))
        self._learn(new)
        slot = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))[unit]
        each = self.sizes[slot]
        to = np.concatenate([[0], np.cumsum(each)])
        out = self.flat[np.repeat(self.base[slot] - to[:-1], each) + np.arange(to[-1])]
        return out, to[np.searchsorted(starts, offsets)]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, block: int = BLOCK) -> DataFrame:
    """First pass, written: key, ids (packed, end id last), n_ids, and task and the ids ``before`` in it."""
    path = tokenizer or vocabulary()
    kept = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = kept.schema["key"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, before, encoder = TaskContext.get().partitionId(), 0, Encoder(path)
        last = np.array([end], encoder.kind)
        if int(last[0]) != end:
            raise ValueError("the end id does not fit the vocabulary's ids")
        for batch in batches:
            for part in slices(batch, "text", block):
                ids, offsets = encoder.encode(*text_buffers(part.column(1)))
                n = np.diff(offsets) + 1
                rows = [np.concatenate([ids[a:b], last]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.binary()), pa.array(n), pa.array(np.full(len(n), task)), pa.array(at), pa.array(np.full(len(n), encoder.kind().itemsize, np.int32))],
                    names=["key", "ids", "n_ids", "task", "before", "width"])

    return cut(kept.mapInArrow(run, f"key {kind}, ids binary, n_ids long, task long, before long, width int"), "ids")


def packed(rows: DataFrame, key: str = "doc_id", length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """Second pass over ``encoded`` rows: one row a piece, with its window (sequence_id) and its offset there."""
    spark = rows.sparkSession
    totals = rows.groupBy("task").agg(F.sum("n_ids").alias("n")).orderBy("task").collect()  # one row a task of the first pass
    base = dict(zip([t["task"] for t in totals], np.concatenate([[0], np.cumsum([t["n"] for t in totals])])[:-1].tolist()))
    base = spark.sparkContext.broadcast(base)
    kind = rows.schema["key"].dataType.simpleString()
    ids_column = ", ids binary" if keep_ids else ""

    def run(batches):
        for batch in batches:
            start_of = base.value
            n = batch.column("n_ids").to_numpy()
            at = batch.column("before").to_numpy() + np.array([start_of[t] for t in batch.column("task").to_pylist()], np.int64)
            pieces = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            window = at[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = np.maximum(window * length, at[row])
            hi = np.minimum((window + 1) * length, (at + n)[row])
            start, size = lo - at[row], hi - lo
            raw, width = batch.column("ids"), batch.column("width").to_pylist()
            parts, r_now, ids = [], -1, None
            for r, a, k in zip(row.tolist(), start.tolist(), size.tolist()):
                if r != r_now:
                    r_now, ids = r, np.frombuffer(raw[r].as_buffer(), f"<u{width[r]}").astype("<u4")
                parts.append(ids[a : a + k].tobytes())
            columns = [batch.column("key").take(pa.array(row)), pa.array(start), pa.array(size), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                       pa.array(n[row]), pa.array(window), pa.array(lo - window * length)]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{ids_column}"
    return rows.mapInArrow(run, schema)


def windows(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id and ids (32-bit, packed) of every window; a short last one is padded unless its size is a power of two."""

    def run(batches):
        window, parts, first, have = None, [], 0, 0
        for batch in batches:
            for w, at, k, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "length", "ids"))):
                if parts and (w != window or at != first + have):
                    yield _record(window, first, have, parts)
                    parts = []
                if not parts:
                    window, first, have = w, at, 0
                parts.append(ids)
                have += k
        if parts:
            yield _record(window, first, have, parts)

    runs = cut(pieces.select("sequence_id", "offset", "length", "ids").mapInArrow(run, "sequence_id long, offset long, length long, ids binary"), "runs")
    whole = runs.where(F.col("length") == length).select("sequence_id", "ids", F.col("length").alias("used"))
    ends = runs.where(F.col("length") < length).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("used"))
    joined = ends.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "used")
    fill = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, F.lit(0)).otherwise(length - F.col("used")).cast("int")
    padding = F.unhex(F.expr(f"repeat('{pad.to_bytes(4, 'little').hex()}', _fill)"))
    return whole.unionByName(joined.withColumn("_fill", fill).withColumn("ids", F.concat("ids", padding)).drop("_fill"))


def _record(window: int, first: int, have: int, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([window], pa.int64()), pa.array([first], pa.int64()), pa.array([have], pa.int64()), pa.array([b"".join(parts)], pa.binary())],
                                      names=["sequence_id", "offset", "length", "ids"])


def op11_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents"))
    return packed(rows, keep_ids=False)
