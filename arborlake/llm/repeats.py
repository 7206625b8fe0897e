"""Windows that repeat across a corpus: anchors, packed exchange and lists by document, for exact substring removal.

A window is a run of ``window`` symbols (bytes, or word hashes) of one document.  Its anchor is the ``gram`` with the
smallest hash inside it, the last one of equals, so equal windows have equal anchors at equal offsets, and each anchor
owns a run of neighbouring windows.  An anchor's stretch is what its windows cover.

Step one compares stretches: tasks send one row for each distinct stretch they meet (anchor hash, stretch hash, place),
packed by reducer, and reducers find the first place of each.  A stretch seen before decides all its windows.
Step two is left with anchors that stand in different stretches: ``stretches`` brings their symbols together, and the
operators compare them window by window in their own way.

A document is known by its id and a hash of its text, so rows that repeat both are one document.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from arborlake.llm.common import byte_class, byte_symbols, cut, mixed, ships, slices, span_hashes, tasks, text_buffers, with_columns_of_text, words_of

ships(__name__)

ANCHORS_EACH = 1_500_000  # anchors of one reducer, on average
HELD = 3 << 17  # anchors that a task holds before it sends them
BROADCAST_IDS = 1_000_000  # ids that are broadcast instead of joined
_BYTES = byte_symbols(6)


@dataclass(frozen=True)
class Kind:
    """What repeats: symbols are the bytes of a text, or its words without ``blanks``; ``later``: only later places repeat."""

    window: int
    gram: int
    blanks: bytes | None
    later: bool

    @property
    def chunk(self) -> int:
        """Bytes of text looked at together: each symbol takes some 150 bytes on the way."""
        return 1 << 19 if self.blanks is None else 1 << 21

    def read(self, column):
        """Symbols of the texts, the rows' bounds among them, and the words' places in the bytes."""
        data, offsets = text_buffers(column)
        if self.blanks is None:
            return _BYTES[data], offsets, (data, offsets, None, None)
        starts, ends, rows = words_of(data, offsets, byte_class(self.blanks))
        return span_hashes(_BYTES[data], starts, ends), rows, (data, offsets, starts, ends)


def anchors(symbols: np.ndarray, rows: np.ndarray, kind: Kind):
    """Anchor place, first and last window it owns (all as places of the block) and anchor hash, in order."""
    w = kind.window - kind.gram + 1
    n = len(symbols) - kind.gram + 1
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n)
    h = span_hashes(symbols, at, at + kind.gram)
    # Place in the low bits, descending: the smallest value is unique and the last of equal hashes wins.
    value = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    pad = np.full(-len(value) % w, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks = np.concatenate([value, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, 1).reshape(-1)
    m = n - w + 1
    least = np.minimum(ahead[:m], behind[w - 1 : w - 1 + m])
    place = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    starts = np.flatnonzero(at[:m] + kind.window <= rows[of[:m] + 1])
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return place[first], starts[first], starts[last], h[place[first]]


_PLACE = np.dtype([("at", "<u4"), ("span", "u1"), ("off", "u1")])  # first window, further windows, anchor after the first
_SENT = np.dtype([("anchor", "<u8"), ("stretch", "<u8"), ("at", "<u4"), ("span", "u1"), ("off", "u1"), ("twice", "u1")])
_OUT = pa.schema([("part", pa.int64()), ("anchors", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("h", pa.int64()), ("done", pa.binary()), ("open", pa.binary())])


def _by_document(ids, hs, done: np.ndarray, places: np.ndarray):
    """(id, h, places that are decided, places left open) rows, from places sorted by document."""
    edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(hs) != 0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
        d, p = done[a:b], places[a:b]
        yield int(ids[a]), int(hs[a]), p[d == 0].tobytes(), p[d == 1].tobytes()


class Sender:
    def __init__(self, kind: Kind, parts: int):
        self.kind, self.parts, self.held, self.n, self.seen = kind, parts, [], 0, set()

    def add(self, part: pa.RecordBatch) -> None:
        ids, hs = (part.column(c).to_numpy() for c in ("id", "h"))
        symbols, rows, _ = self.kind.read(part.column("text"))
        place, first, last, h = anchors(symbols, rows, self.kind)
        of = np.searchsorted(rows, first, "right") - 1
        fresh = np.zeros(len(ids), bool)
        for i, key in enumerate(zip(ids.tolist(), hs.tolist())):
            if key not in self.seen:
                self.seen.add(key)
                fresh[i] = True
        keep = fresh[of]
        place, first, last, h, of = place[keep], first[keep], last[keep], h[keep], of[keep]
        out = np.zeros(len(of), _SENT)
        out["anchor"], out["stretch"] = h, span_hashes(symbols, first, last + self.kind.window)
        out["at"], out["span"], out["off"] = first - rows[of], last - first, place - first
        self.held.append((ids[of], hs[of], out))
        self.n += len(out)

    def send(self):
        """Packed rows by reducer, and rows of places that this task decides."""
        ids, hs, out = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        order = np.lexsort((out["at"], hs, ids, out["off"], out["stretch"], out["anchor"]))
        ids, hs, out = ids[order], hs[order], out[order]
        same = np.zeros(len(out), bool)
        same[1:] = (out["anchor"][1:] == out["anchor"][:-1]) & (out["stretch"][1:] == out["stretch"][:-1]) & (out["off"][1:] == out["off"][:-1])
        twice = same.copy()
        twice[:-1] |= same[1:]
        local = same if self.kind.later else twice
        decided = _sorted_rows(ids[local], hs[local], np.zeros(local.sum(), np.int8), out[local])
        out["twice"] = twice
        ids, hs, out = ids[~same], hs[~same], out[~same]
        part = (mixed(out["anchor"]) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ids, hs, out, part = ids[order], hs[order], out[order], part[order]
        edges = np.flatnonzero(np.diff(part)) + 1
        sent = [(int(part[a]), out[a:b].tobytes(), np.stack([ids[a:b], hs[a:b]], 1).tobytes())
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]) if b > a]
        return sent, decided


def _sorted_rows(ids, hs, done, out):
    if not len(ids):
        return []
    order = np.lexsort((out["at"], hs, ids))
    places = np.zeros(len(ids), _PLACE)
    for c in _PLACE.names:
        places[c] = out[c][order]
    return list(_by_document(ids[order], hs[order], done[order], places))


def _batches(rows, names):
    for at in range(0, len(rows), 2_000):
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[at : at + 2_000]], _OUT)


def identified(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, h, text): null texts are empty, a null id comes before all others."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(whole).alias("h"), whole.alias("text"))


def marks(named: DataFrame, kind: Kind) -> DataFrame:
    """(id, h, done, open) by document: packed places whose windows repeat, and places to compare window by window."""
    spark = named.sparkSession
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unit = 1 if kind.blanks is None else 6
    parts = int(max(tasks(spark), 2 * size // (unit * (kind.window - kind.gram) * ANCHORS_EACH)))

    def send(batches):
        sender = Sender(kind, parts)

        def rows():
            sent, decided = sender.send()
            yield from _batches(sent, ("part", "anchors", "ids"))
            yield from _batches([(r[0] % parts, *r) for r in decided], ("part", "id", "h", "done", "open"))

        for batch in batches:
            for part in slices(batch, limit=kind.chunk):
                sender.add(part)
                if sender.n >= HELD:
                    yield from rows()
        if sender.n:
            yield from rows()

    ddl = "part bigint, anchors binary, ids binary, id bigint, h bigint, done binary, open binary"
    def meet(batches):
        raw, names = [], []
        for batch in batches:
            decided = pc.is_valid(batch.column("id"))
            yield batch.filter(decided)
            batch = batch.filter(pc.invert(decided))
            for a, i in zip(batch.column("anchors").to_pylist(), batch.column("ids").to_pylist()):
                out, who = np.frombuffer(a, _SENT), np.frombuffer(i, np.int64).reshape(-1, 2)
                raw.append(out)
                names.append(who)
        if not raw:
            return
        out, who = np.concatenate(raw), np.concatenate(names)
        order = np.argsort(out["anchor"], kind="stable")
        a = out["anchor"][order]
        several = np.zeros(len(a), bool)
        several[1:] = a[1:] == a[:-1]
        several[:-1] |= several[1:]
        order = order[several]
        out, who = out[order], who[order]
        order = np.lexsort((out["at"], who[:, 1], who[:, 0], out["off"], out["stretch"], out["anchor"]))
        out, ids, hs = out[order], who[order, 0], who[order, 1]
        twin = np.zeros(len(out), bool)  # the same place, from two tasks that read the same document
        group = np.zeros(len(out), bool)
        group[1:] = (out["anchor"][1:] == out["anchor"][:-1]) & (out["stretch"][1:] == out["stretch"][:-1]) & (out["off"][1:] == out["off"][:-1])
        twin[1:] = group[1:] & (ids[1:] == ids[:-1]) & (hs[1:] == hs[:-1]) & (out["at"][1:] == out["at"][:-1])
        out, ids, hs, group = out[~twin], ids[~twin], hs[~twin], group[~twin]
        several = group.copy()
        several[:-1] |= group[1:]
        head = np.ones(len(out), bool)
        head[1:] = out["anchor"][1:] != out["anchor"][:-1]
        block = np.cumsum(head) - 1
        stretches_of = np.bincount(block, weights=~group)[block] if len(out) else np.zeros(0)
        done = group if kind.later else several | (out["twice"] > 0)
        left = ~group & (stretches_of > 1)
        both = np.concatenate([np.flatnonzero(done), np.flatnonzero(left)])
        what = np.concatenate([np.zeros(done.sum(), np.int8), np.ones(left.sum(), np.int8)])
        yield from _batches(_sorted_rows(ids[both], hs[both], what, out[both]), ("id", "h", "done", "open"))

    # What a task decided travels with what is left, so that nothing is computed or stored twice.
    rows = named.mapInArrow(send, ddl).repartition(parts, "part").mapInArrow(meet, ddl).select("id", "h", "done", "open")
    packed = lambda c: F.filter(F.collect_list(c), lambda x: F.octet_length(x) > 0)
    return cut(rows.groupBy("id", "h").agg(packed("done").alias("done"), packed("open").alias("open")), "marks")


def narrowed(named: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ``ids``; few ids are broadcast, so that other texts are not shuffled for the joins that follow."""
    if ids.count() <= BROADCAST_IDS:
        return named.join(F.broadcast(ids), ["id", "h"], "left_semi")
    return named.join(ids, ["id", "h"], "left_semi")


def stretches(named: DataFrame, places: DataFrame, kind: Kind) -> DataFrame:
    """(id, h, at, off, symbols) of the open places: the symbols that the windows of each cover."""
    todo = places.where(F.size("open") > 0).select("id", "h", "open")
    rows = narrowed(named, todo.select("id", "h")).dropDuplicates(["id", "h"]).join(todo, ["id", "h"])
    out = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("off", pa.int64()), ("symbols", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=kind.chunk):
                symbols, bounds, (data, _, starts, _) = kind.read(part.column("text"))
                raw = data if kind.blanks is None else symbols
                for r, (i, h, blobs) in enumerate(zip(*(part.column(c).to_pylist() for c in ("id", "h", "open")))):
                    place = np.frombuffer(b"".join(blobs), _PLACE)
                    base = int(bounds[r])
                    a = base + place["at"].astype(np.int64)
                    b = a + place["span"] + kind.window
                    k = len(place)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(k, i, np.int64)), pa.array(np.full(k, h, np.int64)), pa.array(place["at"].astype(np.int64)),
                        pa.array(place["off"].astype(np.int64)), pa.array([raw[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary())], schema=out)

    return rows.mapInArrow(run, "id bigint, h bigint, at bigint, off bigint, symbols binary")


def refined(base: np.ndarray, group: np.ndarray, token_at, rounds: int):
    """Members (indices) of groups of equal windows, and their group numbers.

    Multikey sort: each round sorts the members of a group by their next token and splits it; singles leave.
    """
    who = np.arange(len(base))
    for t in range(rounds):
        token = token_at(base[who], t)
        order = np.lexsort((token, group))
        who, group, token = who[order], group[order], token[order]
        new = np.ones(len(who), bool)
        new[1:] = (group[1:] != group[:-1]) | (token[1:] != token[:-1])
        number = np.cumsum(new) - 1
        keep = np.bincount(number, minlength=1)[number] > 1 if len(number) else new
        who, group = who[keep], number[keep]
    return who, group


def finished(docs: DataFrame, id: str, text: str, parts: list[DataFrame], kind: Kind, added: str, work) -> DataFrame:
    """``docs`` with the columns that ``work`` makes of a batch and its runs of repeated windows.

    ``parts`` are (id, h, runs) tables of packed (first window, further windows); documents without are not shuffled
    while the ids of the others are few.
    """
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.unionByName(p)
    runs = cut(runs.groupBy("id", "h").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.withColumns({"_id": F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64(whole)})
    runs = runs.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("runs").alias("_runs"))
    if runs.count() <= BROADCAST_IDS:
        ids = F.broadcast(runs.select("_id", "_h"))
        some = named.join(ids, ["_id", "_h"], "left_semi").join(runs, ["_id", "_h"])
        rest = named.join(ids, ["_id", "_h"], "left_anti").withColumn("_runs", F.array().cast("array<binary>"))
        named = some.unionByName(rest)
    else:
        named = named.join(runs, ["_id", "_h"], "left")
    return with_columns_of_text(named, added, work, text, kind.chunk).drop("_id", "_h", "_runs")


def covered(rows: np.ndarray, blobs: list, kind: Kind) -> np.ndarray:
    """True for the symbols of a batch that repeated windows cover."""
    edge = np.zeros(int(rows[-1]) + 1, np.int64)
    for r, packed in enumerate(blobs):
        if packed:
            place = np.frombuffer(b"".join(packed), _PLACE)
            a = rows[r] + place["at"].astype(np.int64)
            np.add.at(edge, a, 1)
            np.add.at(edge, a + place["span"] + kind.window, -1)
    return np.cumsum(edge)[:-1] > 0


def runs_of(ids, hs, starts) -> list[tuple]:
    """(id, h, runs) rows from single window starts."""
    if not len(ids):
        return []
    order = np.lexsort((starts, hs, ids))
    places = np.zeros(len(ids), _PLACE)
    places["at"] = starts[order]
    return [(i, h, [done]) for i, h, done, _ in _by_document(ids[order], hs[order], np.zeros(len(ids), np.int8), places)]
