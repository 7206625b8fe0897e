"""Substring dedup by prefix-partitioned suffix trees: words in windows of 35 that occur more than once are removed.

Suffixes that can matter start at anchors that stand in different surroundings (see ``repeats``); the rest is decided
by whole stretches.  They are split by prefixes of variable length: one word where few enough suffixes start with it,
else three, six or twelve, so that each group fits a task; suffixes that share twelve words and are still too many
are dealt out by document, and their windows compared across the groups by hash.  Each group grows its subtree from
the root down, seven words to an edge; nodes of depth 35 with two leaves or more are repeats, and all their leaves go.

Defined cases: a null text has no words; rows that repeat id and text are one document, no repeat of itself, and get
equal results; rows of one id and different texts are different documents.  Extra columns pass through; the added
ones (n_words, n_removed, kept) replace columns of those names.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm.common import BLANKS, cut, ships, span_hashes, table, tasks
from arborlake.llm.repeats import Kind, covered, finished, identified, marks, refined, runs_of, stretches
from arborlake.llm.suffix_array_dedup import windows_of

ships(__name__)

WORDS = Kind(window=35, gram=12, blanks=BLANKS, later=False)
EDGE = 7
PREFIXES = (1, 3, 6, 12)
GROUP = 20_000  # suffixes of one subtree
_OUT = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("runs", pa.list_(pa.binary())), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("single", pa.bool_())])


def prefixed(suffixes: DataFrame) -> DataFrame:
    """Adds prefix (of variable length) and salt: the group of each suffix; ``cut_up`` where a prefix has several."""
    words = lambda n: F.substring("symbols", F.col("off").cast("int") * 8 + 1, F.lit(8 * n))
    last = PREFIXES[-1]
    rows = suffixes.withColumn("longest", words(last))
    sizes = rows.groupBy("longest").agg(F.count("*").alias(f"n{last}"))
    for n in PREFIXES[:-1]:
        short = F.substring("longest", 1, 8 * n)
        total = sizes.groupBy(short.alias("short")).agg(F.sum(f"n{last}").alias(f"n{n}"))
        sizes = sizes.withColumn("short", short).join(total, "short").drop("short")
    prefix = F.col("longest")
    for n in reversed(PREFIXES[:-1]):
        prefix = F.when(F.col(f"n{n}") <= GROUP, F.substring("longest", 1, 8 * n)).otherwise(prefix)
    salts = F.ceil(F.col(f"n{last}") / GROUP)
    plan = sizes.select("longest", prefix.alias("prefix"), salts.alias("salts"))
    return rows.join(plan, "longest").withColumns({
        "salt": F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(0), "cut_up": F.col("salts") > 1}).drop("longest", "salts")


def deep_nodes(rows: list[tuple]):
    """Leaves of the nodes of depth 35 with several places; and the windows of all others."""
    where, group, ids, hs, at = windows_of(rows, 1024, 8, WORDS.window)
    symbols = np.frombuffer(b"".join(r[5] for r in rows), np.uint64)
    places = np.arange(len(symbols) - EDGE + 1)
    edge = span_hashes(symbols, places, places + EDGE)
    _, group = np.unique(group, return_inverse=True)
    who, node = refined(where, group, lambda base, t: edge[base + EDGE * t], WORDS.window // EDGE)
    order = np.lexsort((at[who], hs[who], ids[who], node))
    who, node = who[order], node[order]
    new = np.ones(len(who), bool)  # places, not rows: a document that was read twice is no repeat of itself
    new[1:] = (node[1:] != node[:-1]) | (ids[who][1:] != ids[who][:-1]) | (hs[who][1:] != hs[who][:-1]) | (at[who][1:] != at[who][:-1])
    several = np.bincount(node, weights=new, minlength=1)[node] > 1 if len(node) else new
    leaves = who[several]
    single = np.ones(len(where), bool)
    single[leaves] = False
    return leaves, single, (where, ids, hs, at, symbols)


def subtrees(suffixes: DataFrame) -> DataFrame:
    def solved(rows, cut_up):
        leaves, single, (where, ids, hs, at, symbols) = deep_nodes(rows)
        runs = runs_of(ids[leaves], hs[leaves], at[leaves])
        for a in range(0, len(runs), 2_000):
            yield pa.RecordBatch.from_pylist([{"id": i, "h": h, "runs": r} for i, h, r in runs[a : a + 2_000]], _OUT)
        if cut_up:  # one row for each window that other groups of this prefix may have
            k1 = span_hashes(symbols, where, where + WORDS.window)
            k2 = span_hashes(symbols ^ np.uint64(0x5555555555555555), where, where + WORDS.window)
            _, pick = np.unique(k1, return_index=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[pick]), pa.array(hs[pick]), pa.nulls(len(pick), pa.list_(pa.binary())), pa.array(k1[pick].astype(np.int64)),
                pa.array(k2[pick].astype(np.int64)), pa.array(at[pick]), pa.array(single[pick])], schema=_OUT)

    def run(batches):
        rows, key = [], None
        for batch in batches:
            for i, h, at, off, symbols, prefix, salt, cut_up in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "at", "off", "symbols", "prefix", "salt", "cut_up"))):
                # Small groups share a forest; a group that is cut up stands alone.
                if key is not None and (prefix, salt) != key[:2] and (len(rows) >= GROUP or cut_up or key[2]):
                    yield from solved(rows, key[2])
                    rows = []
                number = 0 if not rows else rows[-1][0] + ((prefix, salt) != key[:2])
                key = (prefix, salt, cut_up)
                rows.append((number, i, h, at, off, symbols))
        if rows:
            yield from solved(rows, key[2])

    n = max(tasks(suffixes.sparkSession), suffixes.count() // GROUP)
    dealt = prefixed(suffixes).repartition(n, "prefix", "salt").sortWithinPartitions("prefix", "salt")
    return cut(dealt.mapInArrow(run, "id bigint, h bigint, runs array<binary>, k1 bigint, k2 bigint, at bigint, single boolean"), "subtrees")


def across(found: DataFrame) -> DataFrame:
    """Repeated places of cut-up prefixes that are alone in their group."""
    edges = found.where("at IS NOT NULL").drop("runs")
    several = edges.groupBy("k1", "k2").agg(F.min(F.struct("id", "h", "at")).alias("a"), F.max(F.struct("id", "h", "at")).alias("b")).where("a <> b").select("k1", "k2")
    alone = edges.where("single").join(several, ["k1", "k2"]).select("id", "h", "at")

    def run(batches):
        for batch in batches:
            runs = runs_of(*(batch.column(c).to_numpy() for c in ("id", "h", "at")))
            yield pa.RecordBatch.from_pylist([{"id": i, "h": h, "runs": r} for i, h, r in runs], pa.schema(list(_OUT)[:3]))

    return alone.mapInArrow(run, "id bigint, h bigint, runs array<binary>")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Adds n_words, n_removed, kept_sha256 and, with ``keep``, kept: the words that stay, joined by a space."""
    named = identified(docs, id, text)
    places = marks(named, WORDS)
    found = subtrees(cut(stretches(named, places, WORDS), "suffixes"))
    decided = places.where(F.size("done") > 0).select("id", "h", F.col("done").alias("runs"))

    def work(part):
        _, rows, (data, offsets, starts, ends) = WORDS.read(part.column(text))
        gone = covered(rows, part.column("_runs").to_pylist(), WORDS)
        shas, kept = [], []
        raw = data.tobytes()
        for r, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
            if gone[a:b].any():
                stay = np.flatnonzero(~gone[a:b]) + a
                stays = b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())])
            else:
                stays = b" ".join(raw[offsets[r] : offsets[r + 1]].split())
            shas.append(hashlib.sha256(stays).hexdigest())
            kept.append(stays)
        total = np.concatenate([[0], np.cumsum(gone)])
        out = [pa.array(np.diff(rows)), pa.array(total[rows[1:]] - total[rows[:-1]]), pa.array(shas)]
        return out + [pa.array([k.decode() for k in kept], pa.string())] * keep

    added = "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep
    return finished(docs, id, text, [decided, found.where("at IS NULL").select("id", "h", "runs"), across(found)], WORDS, added, work)


def op7_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH word AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g
   FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM word WHERE len(w) >= 35)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT pos) AS places FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS pos FROM win SEMI JOIN again USING (g)) GROUP BY doc_id),
kept AS (SELECT doc_id, array_to_string(list(x ORDER BY pos), ' ') AS k FROM (
   SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM word) w ANTI JOIN (SELECT doc_id, unnest(places) AS pos FROM gone) g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM word LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
