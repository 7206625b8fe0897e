"""Prefix trie of conversations: every distinct run of first turns is a node, with counts over its subtree.

A turn is a record: a digest of (role, text) and the code points of the text.  ``sequences`` makes one row a
conversation, its records in order; ``trie`` deals these rows out by ranges of (records, conversation), so one shard is
one stretch of the sorted order and any group of equal or alike conversations can be split.

In a shard (``shard_nodes``) digests become dense numbers in a padded matrix of at most ``WIDTH`` columns, sorted by
numpy's lexsort; rows that go on beyond it take the next columns among their equals.  Column changes, OR-accumulated
along a row, tell how many turns a row shares with the one before, which marks where nodes start.  All that a node
needs is then a sum over its rows (reduceat, once for each depth): new nodes and their text count where they start,
leaves where they end.

Nodes that go over a shard's edge are those with depth up to what the rows on both sides of it share.  They come as
partial sums, meet by digest of their path, and give their smallest member back to their children in each shard.  The
ids of the conversations that end in such a node are hashed one shard after the other, as the digest's definition asks.

Defined cases: null role and text are empty; turns with equal numbers are in order of their digests, and so are repeated
rows, which stay; rows without a conversation id belong to no conversation and are left out; other columns are not
looked at; without conversations there are no nodes.  One conversation is one row, 20 bytes a turn.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.llm.common import cut, cut_counted, ships, table, tasks

ships(__name__)

RECORD, WIDTH = 20, 16
SHARD_TURNS = 1 << 20  # turns of one shard, at some 100 bytes each
BASE, MOST_SHARED = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()


def record(role: Column, text: Column) -> Column:
    """40 hex digits: 128 bits of a digest of role and text, then the code points of the text."""
    r, t = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32)
    return F.concat(digest, F.lower(F.lpad(F.hex(F.length(t)), 8, "0")))


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and records of each conversation, in order of its turns, null first."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), record(F.col(role), F.col(text)).alias("record")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["record"].alias("records"))


def rebuilt(rows: DataFrame, base: int = BASE, most: int = MOST_SHARED) -> DataFrame:
    """Each conversation c with its first h records replaced by those of conversation c - c % base, h = crc32(c) % most."""
    c = F.col("conv_id")
    heads = rows.where(c % base == 0).select(c.alias("_base"), F.slice("records", 1, most - 1).alias("_head"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    met = rows.withColumns({"_h": h, "_base": c - c % base}).join(heads, "_base", "left")
    head = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), F.col("_h"))
    own = F.slice("records", F.col("_h") + 1, F.greatest(F.size("records") - F.col("_h"), F.lit(0)))
    return met.select("conv_id", F.concat(head, own).alias("records"))


def _sorted_rows(ids: np.ndarray, off: np.ndarray, size: np.ndarray, conv: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order, and how many records each shares with the one before."""
    order, pos, shared = np.arange(len(size)), np.arange(len(size)), np.zeros(len(size), np.int64)
    rows, rank, at = np.arange(len(size)), np.zeros(len(size), np.int64), 0
    while len(rows):
        k = np.clip(size[rows] - at, 0, width)
        matrix = np.full((len(rows), width), -1, np.int64)
        r = np.repeat(np.arange(len(rows)), k)
        c = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        matrix[r, c] = ids[off[rows][r] + at + c]
        more = size[rows] > at + width
        by = np.lexsort((conv[rows], more, *matrix.T[::-1], rank))
        rows, matrix, more, rank = rows[by], matrix[by], more[by], rank[by]
        order[pos] = rows
        change = np.ones((len(rows), width + 1), bool)
        change[1:, 0] = rank[1:] != rank[:-1]
        change[1:, 1:] = matrix[1:] != matrix[:-1]
        starts = np.logical_or.accumulate(change, axis=1)
        goes_on = ~starts[:, 0]
        same = at + (width - starts[:, 1:].sum(1))
        shared[pos[goes_on]] = np.minimum(same, size[rows])[goes_on]
        rank = np.cumsum(starts[:, -1])[more]
        rows, pos, at = rows[more], pos[more], at + width
    return order, shared


_FIELDS = [("shard", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
           ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
           ("side", pa.int32()), ("parent_side", pa.int32()), ("key", pa.binary()), ("ends", pa.binary())]
NODES = "shard int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, side int, parent_side int, key binary, ends binary"


def shard_nodes(shard: int, conv: np.ndarray, seqs: list[bytes], before: int, after: int, width: int = WIDTH) -> list[dict]:
    """Columns of the nodes of one shard, depth by depth.

    ``before`` and ``after`` are the records that the first row shares with the row before it and the last row with the
    row after it; -1 where there is no such row.  side 0 (1): a partial node that holds the first (last) row.
    """
    size = np.array([len(s) // RECORD for s in seqs], np.int64)
    off = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(seqs), np.uint8).reshape(-1, RECORD)
    high, low, chars = (np.ascontiguousarray(raw[:, a:b]).view(t).ravel() for a, b, t in ((0, 8, ">u8"), (8, 16, ">u8"), (16, 20, ">u4")))
    by = np.lexsort((low, high))
    ids = np.zeros(len(by), np.int64)
    ids[by[1:]] = np.cumsum((high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1]))
    order, shared = _sorted_rows(ids, off, size, conv, width)
    conv, size, off, shared[0] = conv[order], size[order], off[order], before
    leaf = (np.append(shared[1:], after) < size).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(chars.astype(np.int64))])
    old = upto[off + np.maximum(shared, 0)] - upto[off]
    whole = upto[off + size] - upto[off]
    fresh = whole - old
    paths = [_digests(seqs[order[0]], before), _digests(seqs[order[-1]], after)]
    out, above = [], None
    node_of = np.zeros(len(size), np.int64)
    for d in range(int(size.max()) + 1):
        idx = np.flatnonzero(size >= d)
        start = shared[idx] < d
        start[0] = True
        starts = np.flatnonzero(start)
        first = idx[starts]
        total = lambda x: np.add.reduceat(x, starts)
        n = np.diff(np.append(starts, len(idx)))
        path = upto[off[first] + max(d - 1, 0)] - upto[off[first]]
        new = shared[first] < d
        members = {"conv_id": np.minimum.reduceat(conv[idx], starts), "n_convs": n, "n_leaves": total(leaf[idx]),
                   "n_children": total(((shared[idx] <= d) & (size[idx] > d)).astype(np.int64)),
                   "saved_tokens": total(whole[idx]) - n * path - total(fresh[idx]) + np.where(new, path - old[first], 0)}
        side = np.full(len(first), -1, np.int32)
        if d <= after and idx[-1] == len(size) - 1:
            side[-1] = 1
        if d <= before and first[0] == 0:
            side[0] = 0
        ending = total((size[idx] == d).astype(np.int64))
        sha, key, ends = [EMPTY] * len(first), [None] * len(first), [None] * len(first)
        for i in np.flatnonzero((ending > 0) | (side >= 0)).tolist():
            who = conv[first[i] : first[i] + ending[i]]
            if side[i] < 0:
                sha[i] = hashlib.sha256(",".join(map(str, who.tolist())).encode()).hexdigest()
            else:
                sha[i], key[i], ends[i] = None, paths[side[i]][d], who.astype("<i8").tobytes()
        if above is None:
            up, up_side = [None] * len(first), np.full(len(first), -1, np.int32)
        else:
            parent = node_of[first]
            up, up_side = above[0][parent], above[1][parent]
        node_of[idx] = np.cumsum(start) - 1
        above = members["conv_id"], side
        out.append({"shard": np.full(len(first), shard), "depth": np.full(len(first), d), "parent_conv_id": up, "parent_side": up_side,
                    "ends_sha256": sha, "side": side, "key": key, "ends": ends, **members})
    return out


def _digests(seq: bytes, upto: int) -> list[bytes]:
    """Digests of the first 0 .. upto records."""
    h, out = hashlib.sha256(), []
    for d in range(upto + 1):
        if d:
            h.update(seq[(d - 1) * RECORD : d * RECORD])
        out.append(h.copy().digest()[:16])
    return out


def _edges(shards: DataFrame) -> DataFrame:
    """before and after of each shard, from the first and last rows of neighbouring shards (one row a shard)."""
    ends = shards.groupBy("shard").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))

    def run(batches):
        held, last = None, -1
        for batch in batches:
            for shard, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is not None:
                    same = _same(held[1], lo)
                    yield _edge(held[0], last, same)
                    last = same
                held = shard, hi
        if held is not None:
            yield _edge(held[0], last, -1)

    return ends.coalesce(1).sortWithinPartitions("shard").select("shard", "lo", "hi").mapInArrow(run, "shard int, before int, after int")


def _edge(*values: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in values], names=["shard", "before", "after"])


def _same(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // RECORD * RECORD
    x, y = np.frombuffer(a[:n], np.uint8).reshape(-1, RECORD), np.frombuffer(b[:n], np.uint8).reshape(-1, RECORD)
    return int(np.logical_and.accumulate((x == y).all(1)).sum())


def _hashed(parts: DataFrame) -> DataFrame:
    """ends_sha256 of each key: its packed ids, shard after shard, through one digest that holds nothing back."""

    def run(batches):
        key, h, some = None, None, False
        for batch in batches:
            for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if key is not None:
                        yield _sha(key, h)
                    key, h, some = k, hashlib.sha256(), False
                if ends:
                    h.update((("," if some else "") + ",".join(map(str, np.frombuffer(ends, "<i8").tolist()))).encode())
                    some = True
        if key is not None:
            yield _sha(key, h)

    dealt = parts.select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    return dealt.mapInArrow(run, "key binary, ends_sha256 string")


def _sha(key: bytes, h) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])


def trie(rows: DataFrame, shard_turns: int = SHARD_TURNS, width: int = WIDTH) -> DataFrame:
    """One row a node of the trie over ``rows`` (conv_id, records)."""
    spark = rows.sparkSession
    flat = rows.select("conv_id", F.unhex(F.array_join("records", "")).alias("seq"))
    flat, seen = cut_counted(flat, "sequences", cells=F.sum(F.length("seq") / RECORD + 1))
    parts = max(tasks(spark), -(-int(seen["cells"] or 0) // shard_turns))
    shards = cut(flat.repartitionByRange(parts, "seq", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    edges = cut(_edges(shards), "edges")

    def run(batch: pa.Table) -> pa.Table:
        conv = batch.column("conv_id").to_numpy().astype(np.int64)
        first = [batch.column(c)[0].as_py() for c in ("shard", "before", "after")]
        made = shard_nodes(first[0], conv, batch.column("seq").to_pylist(), first[1], first[2], width)
        return pa.table([pa.chunked_array([pa.array(d[name], kind) for d in made], kind) for name, kind in _FIELDS], names=[n for n, _ in _FIELDS])

    nodes = cut(shards.join(F.broadcast(edges), "shard").groupBy("shard").applyInArrow(run, NODES), "nodes")  # edges: three numbers a shard
    shared = nodes.where(F.col("key").isNotNull())
    sums = shared.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    whole = cut(sums.join(_hashed(shared), "key"), "shared")
    known = shared.select("shard", "side", "depth", "key").join(whole.select("key", F.col("conv_id").alias("_up")), "key").select(
        "shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "_up")
    asks = nodes.where(F.col("parent_side") >= 0).join(known, ["shard", "parent_side", "depth"])
    ups = asks.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("_up").alias("parent_conv_id"))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return (
        nodes.where(F.col("key").isNull() & (F.col("parent_side") < 0)).select(*names)
        .unionByName(asks.where(F.col("key").isNull()).withColumn("parent_conv_id", F.col("_up")).select(*names))
        .unionByName(whole.join(ups, "key", "left").select(*names)))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


#: One step of CRC-32 for each byte; a node is looked for among all prefixes of all conversations.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
   lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h FROM own),
seq AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
   FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
pre AS (SELECT conv_id, turns, d, turns[1:d] AS p FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM seq)),
node AS (SELECT d AS depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(turns)) = d AS is_leaf,
   string_agg(CASE WHEN len(turns) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM pre GROUP BY d, p),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
sub AS (SELECT a.p, count(*) FILTER (is_leaf) AS n_leaves, sum((n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(n.p[depth].text) END)::BIGINT AS saved
   FROM (SELECT p AS whole, unnest([p[1:k] for k in range(depth + 1)]) AS p FROM node) a JOIN node n ON n.p = a.whole GROUP BY a.p)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens,
   sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n JOIN sub ON sub.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN node u ON u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
"""
