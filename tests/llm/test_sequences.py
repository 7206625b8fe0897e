"""Token windows, collocations and the conversation trie against brute force, on odd rows and with low limits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import collocations, conversation_trie, packing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


ODD = [None, "", " ", "\n", "a", "a  b", "  x", "x   y", "it's 'quoted'. they'll", "ab...  cd!!\n\n\tef", "×. ÷, é.è é's", "日本語 テスト。 ok", "  x  .", "<|endoftext|>",
       "a<|endoftext|> b <|endoftext|>", "x\x1f y\x85 z", "é. é f", "  lead", "trail  ", "1,000.50 $5", "𝔘𝔫 🙂🙂. ok", "A.b.C-d_e", "a\r\n b", "- - --", "no​. zero"]


def test_units_have_the_ids_of_whole_texts(tokenizer, prose):
    encoder = packing.Encoder(packing.vocabulary())
    r = random.Random(5)
    texts = ODD[1:] + ["".join(r.choice(["a", "é", " ", "  ", ".", "'", "s", "\n", " ", "7", "×", "語", ",", "-"]) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    assert encoder.by_unit
    raw = [t.encode() for t in texts]
    ids, offsets = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_id_lies_in_one_piece_and_windows_are_full(spark, docs, prose, tokenizer):
    rows = list(enumerate(ODD)) + [(100 + i, prose(i, i * 7 % 90)) for i in range(60)] + [(3, "a"), (None, "b c"), (None, "b c"), (900, prose(1, 30_000))]
    table = docs(rows).repartition(5)
    for length in (16, 2048):
        encoded = packing.encoded(table, block=500)
        pieces = packing.packed(encoded, length=length).cache()
        got = pieces.collect()
        by_text = defaultdict(list)
        for p in got:
            by_text[p["sequence_id"]].append(p)
        last = max(by_text)
        assert sorted(by_text) == list(range(last + 1))
        for w, parts in by_text.items():
            parts.sort(key=lambda p: p["offset"])
            assert [p["offset"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts]])[:-1].tolist()
            assert w == last or sum(p["length"] for p in parts) == length
        want = Counter()
        for i, t in rows:
            want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])] += 1
        line = [(p["doc_id"], p["start"], p["doc_tokens"], np.frombuffer(p["ids"], "<u4")) for w in sorted(by_text) for p in by_text[w]]
        have, now = Counter(), []
        for i, start, n, ids in line:
            assert start == len(now)
            now += ids.tolist()
            if len(now) == n:
                have[i, tuple(now)] += 1
                now = []
        assert have == want and not now
        assert all(p["ids_crc32"] == zlib.crc32(p["ids"]) for p in got)
        whole = {w["sequence_id"]: w for w in packing.windows(pieces, length).collect()}
        for w, parts in by_text.items():
            ids, used = b"".join(bytes(p["ids"]) for p in parts), sum(p["length"] for p in parts)
            full = used if used & (used - 1) == 0 else length
            assert bytes(whole[w]["ids"]) == ids.ljust(4 * full, b"\0") and whole[w]["used"] == used
        assert len(whole) == len(by_text)
        pieces.unpersist()


def test_packing_of_nothing(spark, docs):
    assert packing.packed(packing.encoded(docs([]))).count() == 0
    got = packing.packed(packing.encoded(docs([(1, None)])), keep_ids=False).collect()
    assert [r[:] for r in got] == [(1, 0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0, 0)]


# Collocations


def brute_phrases(rows, least, longest, covered):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = {}
    found = [(lang, p) for (lang, p), c in f.items() if len(p) > 1 and c >= least]
    for lang, p in found:
        a = f[lang, p]
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        drop = any(other == lang and len(q) > len(p) and 100 * f[lang, q] >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for other, q in found)
        out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], score, n[lang], drop)
    return out


def texts_with_phrases(seed):
    r = random.Random(seed)
    words = ["the", "The", "a", "of", "river", "stone", "é", "É", "x" * 300, "#", "new", "york", "city"]
    rows = [(r.choice(["en", "de", None, "und"]), " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\n", "\t", "!"]) for _ in range(r.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "New York City hall of new york city"), ("en", "a a a a a a"), (None, None), ("en", ""), (None, " \t "), ("fr", "une seule fois")] * 12
    rows += [("en", "the river " * 3000)]
    return rows


@pytest.mark.parametrize("longest", [3, 4])
def test_phrases_against_brute_force_with_low_limits(spark, longest):
    rows = texts_with_phrases(3)
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, n int, score string").repartition(4)
    want = brute_phrases(rows, 10, longest, 50)
    assert any(v[5] for v in want.values()) and any(k[0] == "und" for k in want)
    for limits in ({}, {"head": 3, "corner": 4, "block": 200, "pending": 20}, {"head": 0, "corner": 0}):
        got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["score"], r["n"], r["dropped"]) for r in collocations.phrases(table, longest=longest, **limits).collect()}
        assert got == want


def test_best_phrases_are_ranked_in_byte_order(spark, monkeypatch):
    rows = texts_with_phrases(4)
    table = spark.createDataFrame(rows, "lang string, text string")
    want = defaultdict(list)
    for (lang, p), v in brute_phrases(rows, 10, 3, 50).items():
        if not v[5]:
            want[lang].append((-v[3], -v[0], p.encode()))
    for ranked in (1 << 16, 2):
        monkeypatch.setattr(collocations, "RANKED", ranked)
        got = defaultdict(list)
        for r in collocations.best(collocations.phrases(table), 7).orderBy("rank").collect():
            got[r["lang"]].append((-r["score"], -r["a"], r["phrase"].encode()))
            assert r["rank"] == len(got[r["lang"]])
        assert dict(got) == {k: sorted(v)[:7] for k, v in want.items()}


def test_another_seed_is_taken_when_two_words_share_a_key(spark, monkeypatch):
    rows = texts_with_phrases(5)
    table = spark.createDataFrame(rows, "lang string, text string")
    want = collocations.phrases(table).orderBy("lang", "phrase").collect()
    plain = collocations.Words.__init__

    def weak(self, batch, seed):
        plain(self, batch, seed)
        if seed < 25:
            self.keys = self.keys % 7

    monkeypatch.setattr(collocations.Words, "__init__", weak)
    assert collocations.word_counts(table)[1] == 25
    assert collocations.phrases(table).orderBy("lang", "phrase").collect() == want


def test_scores_beyond_64_bits_are_exact(spark):
    a, l, r = 10**14 + 7, 3 * 10**14 + 1, 10**14 + 9
    got = spark.range(1).select(collocations._score(F.lit(a), F.lit(l), F.lit(r))).first()[0]
    assert got == 1_000_000 * a * a // (l * r)


def test_sums_of_tiles_with_many_and_with_few_entries():
    r = np.random.default_rng(1)
    keys = np.concatenate([r.integers(0, 40, 5000) * 1000 + r.integers(0, 40, 5000), r.integers(0, 10**6, 300)])
    counts = r.integers(1, 1 << 40, len(keys))
    want = defaultdict(int)
    for k, c in zip(keys.tolist(), counts.tolist()):
        want[k] += c
    got = collocations.summed(keys, counts, 1000)
    assert dict(zip(got[0].tolist(), got[1].tolist())) == want and len(got[0]) == len(want)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.best(collocations.phrases(empty)).count() == 0
    few = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert collocations.best(collocations.phrases(few)).count() == 0


# Conversation trie


def brute_trie(seqs):
    """Nodes of {conv: [(role, text), ...]} by definition."""
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    kids = Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        ends = sorted(c for c in m if len(seqs[c]) == len(p))
        out[min(m), len(p)] = (
            min(members[p[:-1]]) if p else None, len(m), kids[p], sum(kids[q] == 0 for q in below[p]),
            sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below[p]), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def nodes(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


def talks(seed, copies):
    r = random.Random(seed)
    rows = []
    for c in range(260):
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice([None, "", "hi", "hé", "yes"])))
    for c in range(1000, 1000 + copies):  # one conversation many times over, then two ways on
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "answer")] + ([(c, 2, "user", "on")] if c % 50 == 0 else [])
    rows += [(500, None, "user", "first"), (500, 0, "user", "second"), (5000, 1, "u", "x")] + [(501, t, "user", f"t{t % 3}") for t in range(90)] + [(502, t, "user", f"t{t % 3}") for t in range(75)]
    rows += [(None, 0, "user", "nobody")] * 5
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("copies, shard_turns, width", [(40, 1 << 20, 16), (900, 1 << 20, 3), (900, 60, 2)])
def test_trie_against_brute_force(spark, copies, shard_turns, width):
    rows = talks(copies, copies)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seq string, shard int").repartition(7)
    built = conversation_trie.rebuilt(conversation_trie.sequences(table))
    want = brute_rebuilt(rows)
    assert {r["conv_id"]: len(r["records"]) for r in built.collect()} == {c: len(t) for c, t in want.items()}
    got = conversation_trie.trie(built, shard_turns, width)
    assert got.count() == len(nodes(got))
    assert nodes(got) == brute_trie(want)


def test_trie_of_turns_with_equal_numbers_and_repeated_rows(spark):
    rows = [(7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "b"), (9, 0, "user", "b"), (9, 0, "user", "a"), (9, 0, "user", "a")]
    made = conversation_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    records = {r["conv_id"]: r["records"] for r in made.collect()}
    assert records[7] == records[9] and len(records[7]) == 3
    got = nodes(conversation_trie.trie(made))
    assert sorted(got) == [(7, 0), (7, 1), (7, 2), (7, 3)] and got[7, 3][5] == hashlib.sha256(b"7,9").hexdigest()


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.trie(conversation_trie.sequences(empty)).count() == 0
    bare = spark.createDataFrame([(3, []), (-2, [])], "conv_id long, records array<string>")
    assert nodes(conversation_trie.trie(bare)) == {(-2, 0): (None, 2, 0, 1, 0, hashlib.sha256(b"-2,3").hexdigest())}


def test_a_hot_first_turn_is_dealt_over_many_shards(spark):
    """Two thirds of all conversations are equal: no shard holds more than a small part of them."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, F.array(F.lit("ab" * 20))).otherwise(F.array(F.lit("ab" * 20), F.rpad(F.sha2(F.col("id").cast("string"), 256), 40, "0"))).alias("records"))
    flat = rows.select(F.col("id").alias("conv_id"), F.unhex(F.array_join("records", "")).alias("seq"))
    dealt = flat.repartitionByRange(30, "seq", "conv_id").withColumn("shard", F.spark_partition_id())
    assert dealt.groupBy("shard").count().agg(F.max("count")).first()[0] < 300
    got = nodes(conversation_trie.trie(rows.withColumnRenamed("id", "conv_id"), 100))
    assert got[0, 1][:4] == (0, 3000, 1000, 1000) and len(got) == 1002
