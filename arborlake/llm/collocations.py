"""Phrase collocation mining by direct-address tiling.

Words that occur often enough get numbers by frequency, texts become runs of numbers (``coded``), and pairs of numbers
are counted in tiles: the frequent corner of the (left, right) plane in a dense grid with numpy's bincount in every
task, the rest as sorted coordinate lists, which meet by bucket of their tile.  There tiles with many entries are
counted by bincount over their cells, the others by sorting.  Frequent pairs get numbers by frequency in turn and are
the left side of the next round (pair, word), and so on up to ``LONGEST`` words.  A phrase occurs no more often than its
parts, so nothing that counts is lost when rarer words and pairs drop out.

The first ``HEAD`` numbers are broadcast, 16 bytes each.  What a block does not find there it lists once, meets the rest
of the numbering by a join, and gets back by block.  Tasks send sums, not occurrences, so a word or pair that makes up
a third of everything is a few entries for each task.

Words are looked up by 64-bit keys of (language, word).  Where counts of a key meet, so do the words, and another
seed is taken should two words share a key, so counts are exact.  Pairs are looked up by left * words + right, below 2**63.

Defined cases: a null language is ``und``; null and empty texts have no words; repeated rows count each time; other
columns are not looked at; an empty table gives no rows.  One text is handled whole, at some 60 times its bytes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.llm.common import Spans, byte_class, byte_symbols, cut, cut_counted, mixed, ships, slices, table, tasks, text_buffers, words_of
from arborlake.plans.running import cumulative

ships(__name__)

LEAST, LONGEST, COVERED, TOP = 10, 3, 50, 2000
UNKNOWN = "und"
HEAD = 1 << 20
CORNER = 1024  # rows and columns of the grid that each task counts by address, 8 bytes a cell
BLOCK = 1 << 19  # bytes of text looked at together
PENDING = 1 << 17  # entries that a task adds before it sums them up, at some 100 bytes each
SIDE = 5  # a tile of a bucket has 2**SIDE rows and columns
RANKED = 1 << 16  # tables up to this size are ranked by a plain window
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_INSIDE = byte_class(b" \t" + _BREAKS)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Words:
    """Words of a batch of texts: their bytes (A-Z in lower case), places, languages and 64-bit keys."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        raw, offsets = text_buffers(batch.column("text"))
        self.data = _FOLD[raw]
        self.starts, self.ends, bounds = words_of(self.data, offsets, _INSIDE)
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        names = batch.column("lang").dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        self.lang = names.indices.to_numpy()[self.row]
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs] or [0], np.uint64)
        self.keys = mixed(Spans(byte_symbols(seed)[self.data]).hashes(self.starts, self.ends) ^ salt[self.lang]).view(np.int64)

    def glued(self) -> np.ndarray:
        """Whether a word follows the one before it in the same piece."""
        stop = np.zeros(256, bool)
        stop[list(_BREAKS)] = True
        stops = np.cumsum(stop[self.data], dtype=np.int64)[self.starts]
        out = np.zeros(len(self.starts), bool)
        out[1:] = (self.row[1:] == self.row[:-1]) & (stops[1:] == stops[:-1])
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct word, and how often it occurs."""
        _, first, which, n = np.unique(self.keys, return_index=True, return_inverse=True, return_counts=True)
        sizes = self.ends - self.starts
        same = np.array_equal(sizes, sizes[first][which]) and np.array_equal(self.lang, self.lang[first][which])
        if same:
            place = _spans(self.starts, sizes)
            same = np.array_equal(self.data[place], self.data[place + np.repeat(self.starts[first][which] - self.starts, sizes)])
        if same:
            return first, n
        whole = self.data.tobytes()
        seen: dict = {}  # two words share a key: each is named, and the caller takes another seed
        for i, (a, b, l) in enumerate(zip(self.starts.tolist(), self.ends.tolist(), self.lang.tolist())):
            seen.setdefault((l, whole[a:b]), []).append(i)
        return np.array([p[0] for p in seen.values()]), np.array([len(p) for p in seen.values()])

    def named(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words at some places, each behind its language and a tab (which no word has), and their sizes."""
        prefix = [np.frombuffer(x.encode() + b"\t", np.uint8) for x in self.langs]
        ahead = np.array([len(x) for x in prefix] or [0])[self.lang[at]]
        own = (self.ends - self.starts)[at]
        sizes = ahead + own
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint8)
        out[_spans(start + ahead, own)] = self.data[_spans(self.starts[at], own)]
        for i, x in enumerate(prefix):
            rows = start[self.lang[at] == i]
            out[rows[:, None] + np.arange(len(x))] = x
        return out, sizes


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class WordSums:
    """Entries (key, count, name) of a bucket, summed up whenever they become many; do equal keys have equal names?"""

    def __init__(self, limit: int):
        self.limit, self.parts, self.size, self.floor, self.clash = limit, [], 0, 0, False

    def add(self, keys: np.ndarray, counts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> None:
        self.parts.append((keys, counts, sizes, data))
        self.size += len(keys)
        if self.size > self.limit + self.floor:
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, counts, sizes, data = (np.concatenate(x) for x in zip(*self.parts))
        starts = np.cumsum(sizes) - sizes
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        self.clash = self.clash or not np.array_equal(sizes, sizes[first][which]) or not np.array_equal(data, data[_spans(starts[first][which], sizes)])
        total = np.zeros(len(first), np.int64)
        np.add.at(total, which, counts)
        self.parts = [(keys[first], total, sizes[first], data[_spans(starts[first], sizes[first])])]
        self.size = self.floor = len(first)
        return self.parts[0]


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text", block: int = BLOCK, pending: int = PENDING) -> tuple[DataFrame, int]:
    """(key, lang, word, n) of all distinct words, written, and the seed with which no two of them share a key."""
    rows, parts = _texts(docs, lang, text), tasks(docs.sparkSession)
    buckets = 4 * parts

    def add(batches):
        bucket, held = None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("keys", "counts", "sizes", "names")]
            for i, at in enumerate(batch.column("bucket").to_pylist()):
                if at != bucket:
                    if held is not None:
                        yield _words(held)
                    bucket, held = at, WordSums(pending)
                held.add(*(np.frombuffer(x[i].as_buffer(), kind) for x, kind in zip(columns, (np.int64, np.int64, np.int64, np.uint8))))
        if held is not None:
            yield _words(held)

    for seed in range(23, 99):

        def count(batches, seed=seed):
            for batch in batches:
                for part in slices(batch, "text", block):
                    words = Words(part, seed)
                    at, n = words.counts()
                    bucket = (words.keys[at].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    at, n, bucket = at[order], n[order].astype(np.int64), bucket[order]
                    data, sizes = words.named(at)
                    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(at) else np.zeros(0, np.int64)
                    ends, upto = np.append(head[1:], len(at)), np.concatenate([[0], np.cumsum(sizes)])
                    columns = [[x[i:j].tobytes() for i, j in zip(head, ends)] for x in (words.keys[at], n, sizes)]
                    columns.append([data[upto[i] : upto[j]].tobytes() for i, j in zip(head, ends)])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[head]), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "keys", "counts", "sizes", "names"])

        sent = rows.mapInArrow(count, "bucket long, keys binary, counts binary, sizes binary, names binary")
        found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "key long, name string, n long, clash boolean")
        named = found.select("key", F.regexp_extract("name", r"(?s)^(.*)\t", 1).alias("lang"), F.substring_index("name", "\t", -1).alias("word"), "n", "clash")
        words, seen = cut_counted(named, "words", clashes=F.count_if("clash"))
        if not seen["clashes"]:
            return words.drop("clash"), seed
    raise RuntimeError("no seed tells the words apart")


def _words(held: WordSums) -> pa.RecordBatch:
    keys, n, sizes, data = held.sums()
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    names = pa.Array.from_buffers(pa.string(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(keys), names, pa.array(n), pa.array(np.full(len(keys), held.clash))], names=["key", "name", "n", "clash"])


def numbered(rows: DataFrame, ties: list[str], least: int = LEAST) -> tuple[DataFrame, int]:
    """Rows with n >= least and ``id``, their rank by n from 0 on; written, with their number."""
    kept = rows.where(F.col("n") >= least).withColumn("_less", -F.col("n"))
    ranks = cumulative(kept, [], "_less", ties, plain_group=RANKED).withColumn("id", (F.col("upto") - 1).cast("long"))
    out, seen = cut_counted(ranks.drop("upto", "total", "_less"), "numbered", rows=F.count(F.lit(1)))
    return out, seen["rows"] or 0


class Numbers:
    """The numbers of keys: the first ``head`` in a broadcast, the rest in a table."""

    def __init__(self, known: DataFrame, size: int, head: int):
        spark = known.sparkSession
        first = known.where(F.col("id") < head).select("key", "id").toArrow()  # at most ``head`` rows of 16 bytes
        keys, ids = first.column("key").to_numpy(), first.column("id").to_numpy()
        order = np.argsort(keys)
        self.head = spark.sparkContext.broadcast((keys[order], ids[order]))
        self.rest = known.where(F.col("id") >= head).select("key", "id") if size > head else None
        self.kind = "<i4" if size < 1 << 31 else "<i8"


def _looked_up(keys: np.ndarray, valid: np.ndarray, head: tuple, rest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key, -1 where there is none; -2 - j for the j-th of the keys to be looked up in the rest."""
    out = np.full(len(keys), -1, np.int64)
    distinct, which = np.unique(keys[valid], return_inverse=True)
    known, ids = head
    none = np.zeros(0, np.int64)
    if not len(distinct):
        return out, none
    if len(known):
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        hit = known[at] == distinct
        found = np.where(hit, ids[at], -1)
    else:
        hit, found = np.zeros(len(distinct), bool), np.full(len(distinct), -1, np.int64)
    if rest:
        found[~hit] = -2 - np.arange((~hit).sum())
    out[valid] = found[which]
    return out, distinct[~hit] if rest else none


def _patched(blocks: DataFrame, column: str, numbers: Numbers) -> DataFrame:
    """``blocks`` with what is still open in a packed column looked up in the rest of the numbers, written."""
    if numbers.rest is None:
        return blocks.drop("open")
    asks = blocks.select("block", F.posexplode("open").alias("j", "key"))
    got = asks.join(numbers.rest, "key").groupBy("block").agg(F.collect_list("j").alias("j"), F.collect_list("id").alias("id"))  # a block's own
    met = blocks.join(got, "block", "left")
    kind, kept = numbers.kind, [c for c in blocks.columns if c != "open"]

    def run(batches):
        for batch in batches:
            packed = []
            for raw, n, j, ids in zip(*(batch.column(c).to_pylist() for c in (column, "n_open", "j", "id"))):
                values = np.frombuffer(raw, kind).astype(np.int64)
                found = np.full(n, -1, np.int64)
                found[np.array(j or [], np.int64)] = np.array(ids or [], np.int64)
                still = values < -1
                values[still] = found[-2 - values[still]]
                packed.append(values.astype(kind).tobytes())
            columns = [pa.array(packed, pa.binary()) if c == column else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    size = F.size("open").alias("n_open")
    return cut(met.select(*kept, size, "j", "id").mapInArrow(run, blocks.select(*kept).schema), "patched")


def coded(docs: DataFrame, numbers: Numbers, seed: int, lang: str = "lang", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of texts as packed numbers of their words, written; -1 stands between pieces and for rarer words."""
    head, rest, kind = numbers.head, numbers.rest is not None, numbers.kind

    def run(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", block):
                words = Words(part, seed)
                ids, unknown = _looked_up(words.keys, np.ones(len(words.keys), bool), head.value, rest)
                gap = ~words.glued()
                out = np.full(len(ids) + int(gap.sum()), -1, np.int64)
                out[np.arange(len(ids)) + np.cumsum(gap)] = ids
                keep = np.ones(len(out), bool)
                keep[1:] = (out[1:] != -1) | (out[:-1] != -1)
                yield _block(name, out[keep].astype(kind), unknown)
                name += 1

    blocks = cut(_texts(docs, lang, text).mapInArrow(run, "block long, codes binary, open array<long>"), "coded")
    return _patched(blocks, "codes", numbers)


def _block(name: int, codes: np.ndarray, unknown: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([codes.tobytes()], pa.binary()), pa.array([unknown], pa.list_(pa.int64()))], names=["block", "codes", "open"])


def extended(blocks: DataFrame, length: int, numbers: Numbers, kinds: list[str], n_words: int) -> DataFrame:
    """Adds ``left``: at each place the number of the phrase of ``length`` words that starts there, or -1."""
    head, rest, kind, code_kind, left_kind = numbers.head, numbers.rest is not None, numbers.kind, kinds[0], kinds[-1]
    before = "left" in blocks.columns

    def run(batches):
        for batch in batches:
            names = batch.column("block").to_pylist()
            codes_of = batch.column("codes")
            lefts = batch.column("left") if before else codes_of
            for i, name in enumerate(names):
                codes = np.frombuffer(codes_of[i].as_buffer(), code_kind).astype(np.int64)
                left = np.frombuffer(lefts[i].as_buffer(), left_kind).astype(np.int64)
                a, b, valid = _pairs(codes, left, length - 1)
                ids, unknown = _looked_up(a * n_words + b, valid, head.value, rest)
                out = np.full(len(codes), -1, np.int64)
                out[: len(ids)] = ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.int64()), codes_of.slice(i, 1), pa.array([out.astype(kind).tobytes()], pa.binary()), pa.array([unknown], pa.list_(pa.int64()))],
                    names=["block", "codes", "left", "open"])

    out = blocks.mapInArrow(run, "block long, codes binary, left binary, open array<long>")
    return _patched(cut(out, "extended"), "left", numbers)  # written, so that no task feeds two Python workers


def _pairs(codes: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left numbers (phrases of ``length`` words), right numbers and where both, and the phrase one word on, are known."""
    n = max(len(codes) - length, 0)
    a, b = left[:n], codes[length : length + n]
    valid = (a >= 0) & (b >= 0)
    if length > 1:
        valid &= left[1 : n + 1] >= 0
    return a, b, valid


def summed(keys: np.ndarray, counts: np.ndarray, n_right: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums: tiles that are well filled by bincount over their cells, the rest by sorting."""
    if not len(keys):
        return keys, counts
    a, b = keys // n_right, keys % n_right
    tile = (a >> SIDE) * ((n_right >> SIDE) + 1) + (b >> SIDE)
    order = np.argsort(tile, kind="stable")
    tile = tile[order]
    head = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    size = np.diff(np.append(head, len(tile)))
    cells = 1 << 2 * SIDE
    dense = np.repeat(size >= cells // 2, size)
    out_keys, out_counts = [], []
    if dense.any():
        which = np.repeat(np.cumsum(size >= cells // 2) - 1, size)[dense]
        some = order[dense]
        low = (1 << SIDE) - 1
        total = np.zeros((int(which[-1]) + 1) * cells, np.int64)
        place = which * cells + ((a[some] & low) << SIDE) + (b[some] & low)
        # bincount adds in doubles, exact below 2**53; larger counts go in two halves
        total += np.bincount(place, counts[some] & 0xFFFFFFFF, len(total)).astype(np.int64)
        if (counts[some] >> 32).any():
            total += np.bincount(place, counts[some] >> 32, len(total)).astype(np.int64) << 32
        full = np.flatnonzero(total)
        corner = tile[head][size >= cells // 2][full // cells]
        width = (n_right >> SIDE) + 1
        left = (corner // width << SIDE) + (full % cells >> SIDE)
        out_keys.append(left * n_right + (corner % width << SIDE) + (full & low))
        out_counts.append(total[full])
    rest = order[~dense]
    if len(rest):
        rest = rest[np.argsort(keys[rest], kind="stable")]
        k = keys[rest]
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        out_keys.append(k[starts])
        out_counts.append(np.add.reduceat(counts[rest], starts))
    return np.concatenate(out_keys), np.concatenate(out_counts)


class Pending:
    """Entries of a task, summed up whenever they become many."""

    def __init__(self, n_right: int, limit: int):
        self.n_right, self.limit, self.parts, self.size, self.floor = n_right, limit, [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if len(keys):
            self.parts.append((keys, counts))
            self.size += len(keys)
        if self.size > self.limit + self.floor:
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts)), self.n_right)]
        self.size = self.floor = sum(len(p[0]) for p in self.parts)
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _packed(keys: np.ndarray, counts: np.ndarray, n_right: int, buckets: int):
    """Rows of (bucket, keys, counts); a bucket takes whole tiles."""
    a, b = keys // n_right, keys % n_right
    tile = ((a >> SIDE) * ((n_right >> SIDE) + 1) + (b >> SIDE)).astype(np.uint64)
    bucket = (mixed(tile) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(bucket))
    if len(head):
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[head]), pa.array([keys[x:y].tobytes() for x, y in zip(head, ends)], pa.binary()),
             pa.array([counts[x:y].tobytes() if counts[x:y].max() >> 31 else counts[x:y].astype("<i4").tobytes() for x, y in zip(head, ends)], pa.binary())],
            names=["bucket", "keys", "counts"])


def pair_counts(
    blocks: DataFrame, length: int, kinds: list[str], n_left: int, n_right: int, least: int = LEAST, corner: int = CORNER, pending: int = PENDING,
) -> DataFrame:
    """(left, right, n) of all pairs (phrase of ``length`` words, next word) with n >= least."""
    if n_left * n_right >= 1 << 63:
        raise ValueError("too many numbers for one 64-bit key")
    spark = blocks.sparkSession
    parts = tasks(spark)
    buckets, code_kind, left_kind = 4 * parts, kinds[0], kinds[-1]
    own = "left" in blocks.columns
    rows, columns = min(corner, n_left), min(corner, n_right)

    def count(batches):
        grid, held = np.zeros(rows * columns, np.int64), Pending(n_right, pending)
        for batch in batches:
            codes_of = batch.column("codes")
            lefts = batch.column("left") if own else codes_of
            for i in range(batch.num_rows):
                codes = np.frombuffer(codes_of[i].as_buffer(), code_kind).astype(np.int64)
                left = np.frombuffer(lefts[i].as_buffer(), left_kind).astype(np.int64)
                a, b, valid = _pairs(codes, left, length)
                a, b = a[valid], b[valid]
                near = (a < rows) & (b < columns)
                grid += np.bincount(a[near] * columns + b[near], minlength=rows * columns)
                held.add(*np.unique(a[~near] * n_right + b[~near], return_counts=True))
                if held.size > 2 * pending:
                    yield from _packed(*held.sums(), n_right, buckets)
                    held = Pending(n_right, pending)
        full = np.flatnonzero(grid)
        yield from _packed(full // max(columns, 1) * n_right + full % max(columns, 1), grid[full], n_right, buckets)
        yield from _packed(*held.sums(), n_right, buckets)

    def add(batches):
        bucket, held = None, None
        for batch in batches:
            keys_of, counts_of = batch.column("keys"), batch.column("counts")
            for i, at in enumerate(batch.column("bucket").to_pylist()):
                if at != bucket:
                    if held is not None:
                        yield _frequent(*held.sums(), n_right, least)
                    bucket, held = at, Pending(n_right, pending)
                keys, counts = np.frombuffer(keys_of[i].as_buffer(), np.int64), counts_of[i].as_buffer()
                held.add(keys, np.frombuffer(counts, "<i4" if counts.size < 8 * len(keys) else np.int64).astype(np.int64))
        if held is not None:
            yield _frequent(*held.sums(), n_right, least)

    sent = blocks.mapInArrow(count, "bucket long, keys binary, counts binary")
    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "left long, right long, n long")


def _frequent(keys: np.ndarray, counts: np.ndarray, n_right: int, least: int) -> pa.RecordBatch:
    some = counts >= least
    return pa.RecordBatch.from_arrays([pa.array(keys[some] // n_right), pa.array(keys[some] % n_right), pa.array(counts[some])], names=["left", "right", "n"])


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) without rounding, for counts below 10**15."""
    d = lambda x: x.cast("decimal(15,0)")
    product, below = F.lit(1_000_000).cast("decimal(7,0)") * d(a) * d(a), d(left) * d(right)
    return F.call_function("div", product, below)


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED,
            head: int = HEAD, corner: int = CORNER, block: int = BLOCK, pending: int = PENDING) -> DataFrame:
    """All candidates: lang, phrase, words, a, l, r, score, n, and whether a longer one covers it (``dropped``)."""
    counts, seed = word_counts(docs, lang, text, block, pending)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    first, n_words = numbered(counts, ["key"], least)
    numbers = Numbers(first, n_words, head)
    blocks = coded(docs, numbers, seed, lang, text, block)
    one = F.array("n")
    word = first.select("id", "lang", F.array("word").alias("words"), one.alias("starts"), one.alias("ends"))
    level, kinds, n_left, found = word, [numbers.kind], n_words, []
    for length in range(2, longest + 1):
        raw = pair_counts(blocks, length - 1, kinds, n_left, n_words, least, corner, pending)
        pairs, size = numbered(cut(raw.withColumn("key", F.col("left") * n_words + F.col("right")), "pairs"), ["left", "right"], least)
        if not size:
            break
        of_left = level.select(F.col("id").alias("left"), "lang", "words", "starts", *(["tail"] if length > 2 else []))
        right = word.select(F.col("id").alias("right"), F.col("words").alias("_word"), F.col("ends").alias("_one"))
        met = pairs.join(of_left, "left").join(right, "right")
        if length == 2:
            met = met.withColumns({"tail": F.col("right"), "_tail_ends": F.col("_one")})
        else:  # the phrase without its first word: the tail of the left one with the same last word
            rest = level.select(F.col("left_id").alias("tail_left"), F.col("right_id").alias("right"), F.col("id").alias("_tail"), F.col("ends").alias("_tail_ends"))
            met = met.withColumnRenamed("tail", "tail_left").join(rest, ["tail_left", "right"]).withColumnRenamed("_tail", "tail")
        here = cut(met.select(
            "id", "lang", F.concat("words", "_word").alias("words"), F.concat("starts", one).alias("starts"),
            F.concat("_tail_ends", one).alias("ends"), "tail", F.col("left").alias("left_id"), F.col("right").alias("right_id"), "n"), "phrases")
        if found:  # does a phrase of this length cover one that is a word shorter?
            over = here.select(F.col("left_id").alias("id"), "n").unionByName(here.select(F.col("tail").alias("id"), "n")).groupBy("id").agg(F.max("n").alias("_over"))
            found[-1] = found[-1].join(over, "id", "left").withColumn("dropped", F.coalesce(100 * F.col("_over") >= covered * F.col("n"), F.lit(False)))
        found.append(here.withColumn("dropped", F.lit(False)))
        if length < longest:
            numbers = Numbers(pairs, size, head)
            blocks = extended(blocks, length, numbers, kinds, n_words)
        level, kinds, n_left = here, [kinds[0], numbers.kind], size
    out = None
    for rows in found:
        part = rows.select("lang", "words", "starts", "ends", F.col("n").alias("a"), "dropped")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "lang string, phrase string, words array<string>, a long, l long, r long, score long, n long, dropped boolean")
    size = F.size("words")
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        _score(F.col("a"), F.element_at("starts", k), F.element_at("ends", size - k)).alias("score"), k.alias("k"),
        F.element_at("starts", k).alias("l"), F.element_at("ends", size - k).alias("r")))
    best = out.withColumn("_cut", F.array_min(cuts)).join(totals, "lang")
    return best.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"), "n", "dropped")


def best(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language that no longer one covers, with their rank."""
    order = {"_s": -F.col("score"), "_a": -F.col("a")}
    ranks = cumulative(candidates.where(~F.col("dropped")).withColumns(order), ["lang"], "_s", ["_a", "phrase"], plain_group=RANKED)
    return ranks.where(F.col("upto") <= top).withColumn("rank", F.col("upto").cast("long"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(phrases(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang,
   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
g1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM ws) GROUP BY ALL),
g2 AS (SELECT lang, x[1] AS x, x[2] AS y, count(*) AS f FROM (SELECT lang, unnest(list_zip(w[:-2], w[2:])) AS x FROM ws WHERE len(w) >= 2) GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, x[1] AS x, x[2] AS y, x[3] AS z, count(*) AS f FROM (SELECT lang, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS x FROM ws WHERE len(w) >= 3)
   GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT g2.lang, g2.x || ' ' || g2.y AS phrase, g2.f AS a, p.f AS l, q.f AS r, 1000000::HUGEINT * g2.f * g2.f // (p.f::HUGEINT * q.f) AS score
   FROM g2 JOIN g1 p ON p.lang = g2.lang AND p.x = g2.x JOIN g1 q ON q.lang = g2.lang AND q.x = g2.y
   WHERE NOT EXISTS (FROM g3 t WHERE t.lang = g2.lang AND 100 * t.f >= 50 * g2.f AND (t.x = g2.x AND t.y = g2.y OR t.y = g2.x AND t.z = g2.y))),
k3 AS (SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || g3.z AS phrase, g3.f AS a, p.f AS l1, u.f AS r1, v.f AS l2, q.f AS r2,
   1000000::HUGEINT * g3.f * g3.f // (p.f::HUGEINT * u.f) AS s1, 1000000::HUGEINT * g3.f * g3.f // (v.f::HUGEINT * q.f) AS s2
   FROM g3 JOIN g1 p ON p.lang = g3.lang AND p.x = g3.x JOIN g1 q ON q.lang = g3.lang AND q.x = g3.z
   JOIN g2 u ON u.lang = g3.lang AND u.x = g3.y AND u.y = g3.z JOIN g2 v ON v.lang = g3.lang AND v.x = g3.x AND v.y = g3.y),
c AS (FROM c2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM k3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM c JOIN n USING (lang) QUALIFY rank <= 2000
"""
