"""Copies, repeats and contamination against brute force; archives and tokens by round trip."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import decontamination, jaccard_join, repeats, sentencepiece_sampling, suffix_array_dedup, suffix_tree_dedup, warc
from arborlake.llm.common import work_dir
from arborlake.llm.components import components


def blanks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def copies(prose):
    """Texts with exact and near copies, shared passages, inner repeats, periodic texts and odd rows."""
    r = random.Random(11)
    shared = prose(900, 70)
    texts = [None, "", "  \n", "one two", "One two", "a" * 450, "ab" * 300, "ab" * 200 + "c", "é" * 120]
    for i in range(12):
        base = prose(100 + i, r.randint(3, 250))
        texts.append(base)
        for _ in range(r.randint(0, 4)):
            words = base.split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"w{r.randrange(9999)}"
            texts.append(" ".join(words))
    for i in range(20):
        texts.append(prose(300 + i, r.randint(0, 40)) + "\n" + shared + " " + prose(400 + i, r.randint(0, 40)))
    texts.append(shared + " " + shared)
    return list(enumerate(texts))


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = blanks("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((up(a), up(b)))
                root[y] = x
    return {i: (len(sets[i]), up(i)) for i in sets}


def test_jaccard_components(docs, copies):
    want = brute_jaccard(copies)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs(copies)).collect()}
    assert got == want


@pytest.mark.parametrize("local", [2_000, 0])
def test_jaccard_chains_and_many_sets_of_a_key(docs, prose, monkeypatch, local):
    """Near copies of near copies, compared within tasks and pivot by pivot."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "LOCAL_SETS", local)
    r = random.Random(2)
    rows, words = [], prose(7, 60).split()
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[r.randrange(len(words))] = f"n{i}"
        if i % 7 == 6:
            words[::4] = [f"m{i}{k}" for k in range(len(words[::4]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(docs(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_jaccard(rows).items()}


def test_each_plan_meets_every_linked_pair():
    r = random.Random(4)
    for _ in range(400):
        n = r.choice([1, 2, 3, 4, 5, 8, 13, 30, 90])
        base = [r.getrandbits(63) for _ in range(n)]
        other = base[: max(1, n - r.randint(0, n // 4 + 1))] + [r.getrandbits(63) for _ in range(r.randint(0, n // 4 + 1))]
        a, b = (np.array(sorted(set(x)), np.uint64) for x in (base, other))
        shared = len(set(a.tolist()) & set(b.tolist()))
        if 100 * shared < 75 * (len(a) + len(b) - shared):
            continue
        bands = dict(jaccard_join.schemes(len(a))), dict(jaccard_join.schemes(len(b)))
        band = max(len(a), len(b)).bit_length()
        assert band in bands[0] and band in bands[1]
        asked = [jaccard_join.needed(s, band, m[band]) for s, m in zip((a, b), bands)]
        least = max(x["plan"] for x in asked)
        for plan in range(least, 4):
            keys = [set(jaccard_join.index_keys(s, band, plan).tolist()) for s in (a, b)]
            need = max(x["need1"] if plan == 1 else x["need3"] if plan == 3 else 1 for x in asked)
            assert len(keys[0] & keys[1]) >= max(need, 1), (n, plan)


def test_jaccard_of_nothing_and_of_repeated_rows(docs):
    assert jaccard_join.classes(docs([])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.classes(docs(rows)).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 7), (9, 5), (None, None)]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)] + [(300, x) for x in range(301, 360)]
    root = {}

    def up(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((up(a), up(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: up(x) for a, b in edges if a != b for x in (a, b)}


def brute_bytes(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_bytes_that_repeat(docs, copies, monkeypatch, tight):
    if tight:  # many buckets, leading strings across their boundaries, joins instead of broadcasts
        monkeypatch.setattr(suffix_array_dedup, "EACH", 2)
        monkeypatch.setattr(suffix_array_dedup, "AT_ONCE", 50)
        monkeypatch.setattr(repeats, "BROADCAST_IDS", 0)
        monkeypatch.setattr(repeats, "ANCHORS_EACH", 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup.without_repeats(docs(copies)).collect()}
    assert got == brute_bytes(copies)


@pytest.mark.parametrize("tight", [False, True])
def test_words_that_repeat(docs, copies, monkeypatch, tight):
    if tight:  # small groups, prefixes of all lengths, cut-up prefixes
        monkeypatch.setattr(suffix_tree_dedup, "GROUP", 2)
        monkeypatch.setattr(repeats, "BROADCAST_IDS", 0)
    counts = Counter(tuple(blanks(t)[k : k + 35]) for _, t in copies for k in range(len(blanks(t)) - 34))
    got = {r.doc_id: r for r in suffix_tree_dedup.without_repeats(docs(copies)).collect()}
    for i, t in copies:
        w = blanks(t)
        gone = {k + j for k in range(len(w) - 34) if counts[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), kept), i


def test_repeats_of_nothing_and_of_repeated_rows(docs, prose):
    assert suffix_array_dedup.without_repeats(docs([])).count() == 0
    assert suffix_tree_dedup.without_repeats(docs([])).count() == 0
    text = prose(1, 80)
    rows = [(1, text), (1, text), (2, prose(2, 80))]
    assert {r.n_removed for r in suffix_array_dedup.without_repeats(docs(rows)).collect()} == {0}
    assert {r.n_removed for r in suffix_tree_dedup.without_repeats(docs(rows)).collect()} == {0}
    rows = [(1, text), (2, text), (None, text)]
    got = {r.doc_id: r.n_removed for r in suffix_array_dedup.without_repeats(docs(rows)).collect()}
    assert got == {None: 0, 1: len(text), 2: len(text)}


def test_jaccard_ids_with_two_texts_and_sets_without_an_id(docs):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    # Far ends that are near only to a text whose id is null.
    left, right = " ".join(three.split()[7:]), " ".join(three.split()[:-7])
    rows = [(5, one), (5, two), (3, one + " x"), (9, two + " y"), (20, left), (21, right), (None, three), (30, "z " * 9)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.classes(docs(rows)).collect()), key=str)
    assert got == sorted([(3, 3), (5, 3), (5, 3), (9, 3), (20, 20), (21, 20), (None, None), (30, 30)], key=str)


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("block", [2 << 20, 400])
def test_contamination(spark, docs, prose, block):
    r = random.Random(8)
    items = [(i, prose(i, r.choice([1, 3, 9, 10, 25]))) for i in range(30)] + [(90, None), (91, " ,;"), (92, "Zebra-quagga"), (None, "okapi tapir")]
    rows = [(0, None), (1, ""), (2, "zebra QUAGGA, okapi  tapir"), (3, "zebra okapi")]
    for k in range(60):
        text = prose(500 + k, r.randint(0, 80))
        item = items[r.randrange(30)][1]
        rows.append((10 + k, text + " ! " + item.upper() * (k % 2) + " " + prose(700 + k, r.randint(0, 30))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontamination.find(docs(rows), bench, block_bytes=block).collect()}
    for i, t in rows:
        w, hit, ids = lowered(t), set(), set()
        for item, it in items:
            v = lowered(it)
            size = min(len(v), 10)
            for s in {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else ():
                for k in range(len(w) - size + 1):
                    if tuple(w[k : k + size]) == s:
                        hit |= set(range(k, k + size))
                        ids.add(item)
        spans = {j for x in got[i].hits for j in range(x.start, x.end)}
        assert (got[i].n_words, spans, got[i]["items"]) == (len(w), hit, sorted(str(x) for x in ids - {None})), i
    empty = decontamination.find(docs(rows), bench.limit(0)).collect()
    assert len(empty) == len(rows) and not any(x.hits for x in empty)


def test_decontamination_of_long_and_repeated_items(spark, docs):
    words = [f"w{i}" for i in range(400)]
    items = [("long", " ".join(words)), *[("again", "one two three four five six seven eight nine ten eleven")] * 200, ("short", "a few words"), ("gap", "x" + " " * 3000 + "y")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    sizes = decontamination.blocked(bench, 1200).groupBy("block").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) <= 1200
    rows = [(i, " ".join(words[i : i + 10])) for i in range(391)] + [(500, "so x y"), (501, items[1][1]), (502, "of a few words"), (503, " ".join(words[5:14]))]
    got = {r.doc_id: (r["items"], [tuple(h) for h in r.hits]) for r in decontamination.find(docs(rows), bench, block_bytes=1200).collect()}
    assert all(got[i] == (["long"], [(0, 10)]) for i in range(391))
    assert got[500] == (["gap"], [(1, 3)]) and got[501] == (["again"], [(0, 11)]) and got[502] == (["short"], [(1, 4)]) and got[503] == ([], [])


def test_sampling_query_returns_the_ids(spark, docs, tmp_path):
    docs([(1, "one text"), (2, None), (3, "žluťoučký kůň")]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sentencepiece_sampling.op3_sentencepiece_sampling(spark, str(tmp_path)).collect()
    assert len(rows) == 3
    for r in rows:
        assert len(r["ids"]) == r.n_samples
        assert [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in r["ids"]] == [s.ids_sha256 for s in r.samples]


def test_archives(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "http://b/\r\nX: y", "<p>x</p>"), (5, "c", "é\r\n\r\nWARC/1.1\r\n" * 9), (6, "d", "big " * 200_000), (7, "e", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, refers_to string")
    base = f"{work_dir(spark)}/warc-test"
    warc.write_monolithic(pages, f"{base}/one")
    done = warc.normalise(spark, f"{base}/one", f"{base}/each").collect()
    assert sum(r.records for r in done) == len(rows)
    got = {r.page_id: r for r in warc.read(spark, f"{base}/each").collect()}
    for i, url, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        assert got[i].record_type == ("response" if i == max(same) else "revisit")
        assert got[i].refers_to == (None if i == max(same) else max(same))
        if i == max(same):
            assert bytes(got[i].payload) == (html or "").encode()
    lines = [r.value.split("\t") for r in spark.read.text(f"{base}/each/*.idx").withColumn("f", F.input_file_name()).collect()]
    assert len(lines) == len(rows)
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(f"{base}/each").collect():
        whole = spark.read.format("binaryFile").load(r.path[: -len("idx")] + "gz").first().content
        for line in bytes(r.content).decode().splitlines():
            _, _, at, size = line.split("\t")
            member = gzip.decompress(bytes(whole)[int(at) : int(at) + int(size)])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")


def test_archives_with_repeated_and_missing_ids(spark, tmp_path):
    """One response among rows with equal ids and payloads; rows without an id refer to one that has it."""
    rows = [(7, "x"), (7, "x"), (3, "x"), (None, "x"), (None, "alone"), (None, "two"), (None, "two"), (8, "x2"), (9, None), (9, "")]
    spark.createDataFrame([(i, "http://u/", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op1_warc_normaliser(spark, str(tmp_path)).collect())
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = Counter()
    for i, size, h, kind, refers in [(7, 1, "x", "response", None), (7, 1, "x", "revisit", 7), (3, 1, "x", "revisit", 7), (None, 1, "x", "revisit", 7), (None, 5, "alone", "response", None),
                                     (None, 3, "two", "response", None), (None, 3, "two", "response", None), (8, 2, "x2", "response", None), (9, 0, "", "response", None), (9, 0, "", "revisit", 9)]:
        want[i, size, sha(h), kind, refers] += 1
    assert got == want


def test_archives_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc_normaliser(spark, str(tmp_path)).count() == 0


def test_folders_have_the_scheme_of_the_file_system(spark):
    assert warc.qualified(spark, "/tmp/somewhere") == "file:/tmp/somewhere" and warc.qualified(spark, "file:///tmp/x").startswith("file:/")


def test_sampled_segmentations_are_exact_draws():
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.MODEL)
    n = 6000
    rows = sentencepiece_sampling.sampled(["the in"] * n, np.arange(n), v, 3)
    first, second, p = Counter(), Counter(), {}
    for r in rows:
        ids = [tuple(s["ids"].tolist()) for s in r]
        assert len(set(ids)) == 3 and [s["perturbed"] for s in r] == sorted((s["perturbed"] for s in r), reverse=True)
        first[ids[0]] += 1
        second[ids[1]] += 1
        p |= {i: math.exp(s["log_prob"]) for i, s in zip(ids, r)}
        assert all(s["log_inclusion"] <= 0 for s in r)
    assert sum(p.values()) == pytest.approx(1, abs=1e-3)
    for i in p:
        again = sum(p[i] * p[j] / (1 - p[j]) for j in p if j != i)
        assert first[i] / n == pytest.approx(p[i], abs=0.02) and second[i] / n == pytest.approx(again, abs=0.02)
    # Inclusion: the mean number of times a segmentation is among the k, by its own inverse weight, is one.
    top = max(p, key=p.get)
    weights = [1 / math.exp(s["log_inclusion"]) for r in rows for s in r if tuple(s["ids"].tolist()) == top]
    assert sum(weights) / n == pytest.approx(1, abs=0.03)


def test_tokens_round_trip(docs, prose):
    texts = [None, "", " ", "a", "▁ ▁▁", "  two  spaces\n\n\tline\r\n", "日本 😀😀 ͸ é", prose(1, 3000), "x" * 5000, "\u0000"]
    got = sentencepiece_sampling.segmentations(docs(enumerate(texts))).collect()
    again = {r.doc_id: r for r in sentencepiece_sampling.segmentations(docs(enumerate(texts)).repartition(3)).collect()}
    for r in got:
        want = hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert {s.decoded_sha256 for s in r.samples} == {want}
        assert r.ids == again[r.doc_id].ids and len({tuple(x) for x in r.ids}) == len(r.samples) == len(r.ids)
    assert [len(r.samples) for r in got][:2] == [1, 1] and got[0].samples[0].log_prob == 0
    assert sentencepiece_sampling.segmentations(docs([])).count() == 0
