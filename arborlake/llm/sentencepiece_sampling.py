"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k, without replacement.

A text becomes SentencePiece's form (a space in front, spaces as U+2581) and a lattice of vocabulary pieces; characters
that no piece has, and U+2581 itself, are byte pieces.  A segmentation's weight is the product of its pieces' weights:
rank-based (Zipf) as the vocabulary has merge ranks, to the power ``ALPHA``, scaled to sum up to one over the lattice.

Perturbed A-star search, from the top down: the root's largest perturbed log-weight is a Gumbel draw.  Walking to a
leaf, each node hands its value to the child drawn by weight; what is left of the node is a branch whose largest value
is a Gumbel draw truncated there.  The branch with the largest value holds the next sample, so k walks give exactly
the k largest of all segmentations' perturbed log-weights: k distinct samples without replacement.  The value of the
next branch, kappa, gives the inclusion probability 1 - exp(-exp(log_prob - kappa)), reported as its logarithm.

No piece crosses the start of a run of spaces or a line end, so the lattice of a text is a row of small ones.  Those of
the distinct units of a block of texts are built once and walked for all places at once.  Draws are hashes of (row key,
sample, place), so a row has the same samples wherever and however often it runs.

Defined cases: null and empty texts have one sample without pieces and log_prob 0; a text with fewer than k
segmentations has them all, each of inclusion 1; equal keys with equal texts have equal samples; a null key is a key of
its own.  Extra columns pass through; the added one (samples) replaces a column of that name.
"""

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm.common import Spans, mixed, ships, table, with_columns_of_text

ships(__name__)

SAMPLES, ALPHA, LONGEST = 2, 1.0, 16
BLOCK = 1 << 20  # bytes of text looked at together, at some 250 bytes of memory for each
_BITS = 22
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
_SPACE, _LITERAL, _LINE = 0x2581, 0x110000, 10


def vocabulary(model: str) -> dict:
    """Hashes (sorted), numbers and log-weights of the pieces, the bytes of each, and the number of byte piece 0."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    n = p.get_piece_size()
    pieces = [p.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    if any("▁" in pieces[i].lstrip("▁") or "\n" in pieces[i] or len(pieces[i]) > LONGEST for i in normal):
        raise ValueError("a piece crosses a space or a line end, or is too long")
    rank = np.minimum(np.array([-p.get_score(i) for i in normal]), n) + 2.7
    weight = -ALPHA * np.log(rank)
    codes = [np.frombuffer(pieces[i].encode("utf-32-le"), "<u4") for i in normal]
    ends = np.cumsum([len(c) for c in codes])
    spans, starts = Spans(_symbols(np.concatenate(codes))), np.concatenate([[0], ends[:-1]])
    h = spans.hashes(starts, ends)
    bits = np.zeros(1 << _BITS, bool)  # of everything that a piece starts with
    for k in range(1, LONGEST + 1):
        some = np.flatnonzero(ends - starts >= k)
        bits[_low(spans.hashes(starts[some], starts[some] + k))] = True
    order = np.argsort(h)
    raw = [pieces[i].replace("▁", " ").encode() for i in range(n)]
    first = next(i for i in range(n) if p.is_byte(i))
    for b in range(256):
        raw[first + b] = bytes([b])
    return {"hash": h[order], "bits": bits, "piece": np.array(normal, np.int32)[order], "weight": weight[order], "raw": raw, "byte": first, "fallback": -ALPHA * np.log(2.0 * n), "size": n}


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def _symbols(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) + np.uint64(0x3C6EF372))


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in SentencePiece's form, and the rows' offsets."""
    parts = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    sizes = np.array([len(p) + (len(p) > 0) for p in parts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(offsets[-1], _SPACE, np.uint32)
    for p, at in zip(parts, offsets[:-1].tolist()):
        out[at + 1 : at + 1 + len(p)] = p
    inner = np.ones(len(out), bool)
    inner[offsets[:-1][sizes > 0]] = False
    out[inner & (out == _SPACE)] = _LITERAL
    out[out == 0x20] = _SPACE
    return out, offsets


class Lattice:
    """The lattices of the distinct units of a block, and where each place of the block is in them.

    Arcs lie together by the place they start from: from ``ptr`` on, ``count`` of them, with their lengths, pieces,
    logarithms of their conditional weights, and running sums of these.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, vocab: dict):
        space, line = codes == _SPACE, codes == _LINE
        start = np.zeros(len(codes), bool)
        start[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        self.starts = np.flatnonzero(start)
        ends = np.append(self.starts[1:], len(codes))
        spans = Spans(_symbols(codes))
        _, first, unit = np.unique(spans.hashes(self.starts, ends), return_index=True, return_inverse=True)
        sizes = (ends - self.starts)[first]
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])  # of each distinct unit
        n = int(sizes.sum())
        where = np.arange(n) - np.repeat(base, sizes) + np.repeat(self.starts[first], sizes)
        left = np.repeat(base + sizes, sizes) - np.arange(n)
        at, arcs = np.arange(n), []
        known = vocab["hash"]
        for k in range(1, LONGEST + 1):
            at = at[left[at] >= k]
            h = spans.hashes(where[at], where[at] + k)
            some = vocab["bits"][_low(h)]
            at, h = at[some], h[some]  # places that a piece of this length or more may start from
            found = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[found] == h
            arcs.append((at[hit], np.full(hit.sum(), k), vocab["piece"][found[hit]], vocab["weight"][found[hit]]))
        bare = np.ones(n, bool)
        bare[arcs[0][0]] = False
        bare = np.flatnonzero(bare)  # characters without a piece: their bytes
        c = codes[where[bare]]
        c = np.where(c == _LITERAL, _SPACE, c).astype(np.int64)
        cost = vocab["fallback"] * (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF))
        arcs.append((bare, np.ones(len(bare), np.int64), np.where(c < 0x80, vocab["byte"] + c, vocab["size"] + c), cost))  # beyond ASCII: spelled out later
        at, size, piece, weight = (np.concatenate(x) for x in zip(*arcs))
        order = np.lexsort((at, left[at]))  # stable: shorter arcs of a place come first
        at, self.size, self.piece, weight = at[order], size[order], piece[order].astype(np.int64), weight[order]
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        self.ptr, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.ptr[at[head]], self.count[at[head]] = head, np.diff(np.append(head, len(at)))
        beta = np.zeros(n + 1)
        end_of = np.repeat(base + sizes, sizes)
        ahead = at + self.size
        inner = ahead < end_of[at]
        level = np.searchsorted(left[at[head]], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist()):  # from the ends of the units backwards
            x, y = head[a], head[b] if b < len(head) else len(at)
            w = weight[x:y] + np.where(inner[x:y], beta[ahead[x:y]], 0.0)
            cuts, many = head[a:b] - x, self.count[at[head[a:b]]]
            top = np.maximum.reduceat(w, cuts)
            total = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, many)), cuts))
            beta[at[head[a:b]]] = total
            weight[x:y] = w - np.repeat(total, many)
        self.log = weight
        run = np.concatenate([[0.0], np.cumsum(np.exp(weight))])
        self.cdf = run[1:] - np.repeat(run[head], self.count[at[head]])
        self.cdf[np.append(head[1:], len(at)) - 1] = 2.0  # rounding never leaves the arcs that exist
        self.place = np.arange(len(codes)) - np.repeat(self.starts, ends - self.starts) + np.repeat(base[unit], ends - self.starts)
        self.stop = np.repeat(ends, ends - self.starts)


def _uniform(seed: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mixed(seed + mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _below(top, mass, u):
    """The largest of Gumbel draws of log-mass ``mass``, given that it is below ``top``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(u)) - mass)


def _walk(lat: Lattice, at: np.ndarray, seed: np.ndarray, row: np.ndarray, offsets: np.ndarray, stream: int, arc: np.ndarray) -> None:
    """Draws an arc at each place of ``at`` and on to the end of its unit; ``arc`` gets them by place."""
    while len(at):
        r = row[at]
        u = _uniform(seed[r], stream, at - offsets[r])
        x = lat.ptr[lat.place[at]]
        more = np.flatnonzero(u >= lat.cdf[x])
        while len(more):
            x[more] += 1
            more = more[u[more] >= lat.cdf[x[more]]]
        arc[at] = x
        after = at + lat.size[x]
        at = after[after < lat.stop[at]]


def sampled(texts: list[str], keys: np.ndarray, vocab: dict, k: int = SAMPLES) -> list[list[dict]]:
    """For each text its samples: ids, log_prob, perturbed and log_inclusion, largest first."""
    codes, offsets = coded(texts)
    n = len(texts)
    out: list[list[dict]] = [[] for _ in range(n)]
    seed = mixed(keys.astype(np.uint64) + np.uint64(0x51ED270B))
    top = -np.log(-np.log(_uniform(seed, 1, np.zeros(n))))
    for i in np.flatnonzero(np.diff(offsets) == 0).tolist():
        out[i].append({"ids": np.zeros(0, np.int32), "log_prob": 0.0, "perturbed": float(top[i]), "log_inclusion": 0.0})
    if not len(codes):
        return out
    lat = Lattice(codes, offsets, vocab)
    row = np.repeat(np.arange(n), np.diff(offsets))
    live = np.flatnonzero(np.diff(offsets) > 0)
    done: list[tuple] = []  # of each sample: token places, arcs, bounds of rows, branch values, what its branch had used
    for j in range(k):
        arc = np.full(len(codes), -1)
        branch = np.full(n, -1)
        if j == 0:
            _walk(lat, lat.starts, seed, row, offsets, 16, arc)
        else:
            chosen = []
            for r in live.tolist():
                best, of, where = max(((vals[b0[r] + x], i, b0[r] + x) for i, (_, _, b0, vals, _) in enumerate(done) if b0[r] < b0[r + 1]
                                       for x in (int(np.argmax(vals[b0[r] : b0[r + 1]])),)), default=(-np.inf, 0, 0))
                if not np.isfinite(best):
                    continue
                places, taken, _, vals, gone = done[of]
                vals[where] = -np.inf
                at = int(places[where])
                used = [*(gone[r][1] if gone.get(r, (-1,))[0] == at else []), int(taken[where])]
                x, m = lat.ptr[lat.place[at]], lat.count[lat.place[at]]
                q = np.exp(lat.log[x : x + m])
                q[np.array(used) - x] = 0.0
                c = np.cumsum(q)
                k_ = int(np.searchsorted(c, _uniform(seed[r : r + 1], 64 + j, np.array([at - offsets[r]]))[0] * c[-1], "right"))
                chosen.append((r, at, int(x) + min(k_, int(np.flatnonzero(q)[-1])), of, used, best))
            live = np.array([c[0] for c in chosen], np.int64)
            if not len(live):
                break
            prefix, from_unit = [], []
            for r, at, mine, of, used, best in chosen:
                places, taken, b0, _, _ = done[of]
                a = b0[r]
                m = int(np.searchsorted(places[a : b0[r + 1]], at))
                arc[places[a : a + m]] = taken[a : a + m]
                arc[at] = mine
                branch[r], top[r] = at, best
                if at + lat.size[mine] < lat.stop[at]:
                    from_unit.append(at + int(lat.size[mine]))
                u = np.searchsorted(lat.starts, [lat.stop[at], offsets[r + 1]])
                prefix.append(lat.starts[u[0] : u[1]])
            _walk(lat, np.concatenate([np.array(from_unit, np.int64), *prefix]), seed, row, offsets, 16 + j, arc)
        places = np.flatnonzero(arc >= 0)
        taken = arc[places]
        bounds = np.searchsorted(places, offsets)
        log_q = lat.log[taken]
        total = np.concatenate([[0.0], np.cumsum(log_q)])
        before = total[:-1] - total[bounds[row[places]]]
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(np.exp(log_q), 1.0))
        gone: dict = {}
        if j:
            for r, at, mine, of, used, best in chosen:
                x, m = lat.ptr[lat.place[at]], lat.count[lat.place[at]]
                q = np.exp(lat.log[x : x + m])
                q[np.array([*used, mine]) - x] = 0.0
                rest[bounds[r] + int(np.searchsorted(places[bounds[r] : bounds[r + 1]], at))] = np.log(q.sum()) if q.sum() > 1e-12 else -np.inf
                gone[r] = (at, used)
        # Shares below 1e-12 are rounding where a place has one way on.
        rest = np.where(rest < np.log(1e-12), -np.inf, rest)
        vals = _below(top[row[places]], before + rest, _uniform(seed[row[places]], 1024 + j, places - offsets[row[places]]))
        vals[np.isneginf(rest)] = -np.inf
        if j:
            vals[places < branch[row[places]]] = -np.inf  # branches of the sample it came from
        done.append((places, taken, bounds, vals, gone))
        pieces = lat.piece[taken].astype(np.int32)
        for r in live.tolist():
            a, b = int(bounds[r]), int(bounds[r + 1])
            out[r].append({"ids": _spelled(pieces[a:b], vocab), "log_prob": float(total[b] - total[a]), "perturbed": float(top[r])})
    for r in range(n):
        if offsets[r] == offsets[r + 1]:
            continue
        kappa = max((float(vals[b0[r] : b0[r + 1]].max(initial=-np.inf)) for _, _, b0, vals, _ in done), default=-np.inf)
        for s in out[r]:
            x = s["log_prob"] - kappa
            s["log_inclusion"] = 0.0 if kappa == -np.inf else float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 700.0)))))
    return out


def _spelled(pieces: np.ndarray, vocab: dict) -> np.ndarray:
    if not len(pieces) or pieces.max() < vocab["size"]:
        return pieces
    out: list[int] = []
    for p in pieces.tolist():
        out += [p] if p < vocab["size"] else [vocab["byte"] + b for b in chr(p - vocab["size"]).encode()]
    return np.array(out, np.int32)


def decoded(ids: np.ndarray, vocab: dict) -> bytes:
    return b"".join(map(vocab["raw"].__getitem__, ids.tolist()))[1:]


_SAMPLE = "n_tokens:bigint,ids_sha256:string,decoded_sha256:string,log_prob:double,perturbed:double,log_inclusion:double"


def segmentations(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SAMPLES, model: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """Adds samples (n_tokens, hashes of the ids and of the decoded text, scores) and, with ``keep_ids``, ids of each.

    ids_sha256 is over the ids as little-endian 32-bit numbers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model))  # a fixed vocabulary
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                      *[(c, pa.float64()) for c in ("log_prob", "perturbed", "log_inclusion")]])

    def work(part):
        vocab = sent.value
        raw = part.column("_key").to_numpy(zero_copy_only=False)
        rows = sampled([t or "" for t in part.column(text).to_pylist()], raw.astype(np.int64).view(np.uint64), vocab, k)
        ids = [s.pop("ids") for row in rows for s in row]
        for s, x in zip((s for row in rows for s in row), ids):
            s |= {"n_tokens": len(x), "ids_sha256": hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(),
                  "decoded_sha256": hashlib.sha256(decoded(x, vocab)).hexdigest()}
        out = [pa.array(rows, pa.list_(kind))]
        if keep_ids:
            inner = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            outer = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            out.append(pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), flat)))
        return out

    keyed = docs.drop("samples", *["ids"] * keep_ids).withColumn("_key", F.xxhash64(F.col(id).cast("string")))
    added = f"samples array<struct<{_SAMPLE}>>" + ", ids array<array<int>>" * keep_ids
    return with_columns_of_text(keyed, added, work, text, BLOCK).drop("_key")


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=True)
    whole = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", F.size("samples").cast("long").alias("n_samples"), F.forall("samples", lambda s: s["decoded_sha256"] == whole).alias("round_trip"), "samples", "ids")
