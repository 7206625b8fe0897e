"""Helpers shared by the text jobs: tables, written cuts, and numpy views of Arrow text columns."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from arborlake.plans.cut import cut, cut_counted, discard, work_dir  # noqa: F401  (used by the jobs)

BLANKS = b" \t\n\x0b\f\r"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 1 << 21  # bytes of text looked at together in one task

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ships(module: str) -> None:
    """Send the functions of a job module to the workers by value, so that they need no copy of this library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def tasks(spark: SparkSession) -> int:
    """Reducers of a shuffle whose rows are packed arrays: Spark's own setting, which the cluster sizes by its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null reads as empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK):
    """Parts of a batch of about ``limit`` bytes of text; one long text is a part of its own."""
    _, offsets = text_buffers(batch.column(column))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK + 1024), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _powers[base] = have = out
    return have[:n]


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row bounds of the words: runs of bytes with ``inside`` set, never across rows.

    The third array has, for each row, the index of its first word, and the number of all words at its end.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inner = inside[data]
    before = np.empty_like(inner)
    before[0] = False
    before[1:] = inner[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inner & ~before)
    after = np.empty_like(inner)
    after[-1] = False
    after[:-1] = inner[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inner & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Spans:
    """64-bit hashes of spans of a sequence of 64-bit symbols, equal for equal content wherever it lies."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(symbols * powers(_BASE, n), out=self.total[1:])
        self.back = powers(_INVERSE, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[ends] - self.total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(symbols).hashes(starts, ends)


def byte_symbols(seed: int, fold: bool = False) -> np.ndarray:
    """A random 64-bit symbol for each byte; with ``fold``, A-Z share those of a-z."""
    out = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))
    if fold:
        out[65:91] = out[97:123]
    return out


def byte_class(outside: bytes) -> np.ndarray:
    """True for the bytes of a word: all but ``outside``."""
    out = np.ones(256, bool)
    out[list(outside)] = False
    return out


def with_columns_of_text(docs: DataFrame, added: str, work, text: str = "text", limit: int = CHUNK) -> DataFrame:
    """``docs`` with the columns of the DDL text ``added``, which ``work`` makes from parts of Arrow batches.

    ``work`` takes a record batch and returns one Arrow array for each added column.  Columns of ``docs`` with these
    names are replaced.
    """
    new = T.StructType.fromDDL(added)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c not in new.names])
    schema = T.StructType([*kept.schema.fields, *new.fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], names=names)

    return kept.mapInArrow(run, schema)
