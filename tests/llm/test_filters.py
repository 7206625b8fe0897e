"""URL filters, quality rules, personal data, toxicity: brute force and odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from arborlake.llm import pii, quality_rules, toxicity, url_filters


def test_url_rules_against_loops(spark):
    hosts = ["net", "x.net", "example.net", "blog.example.net", "notexample.net", "Example.COM", "a.b.example.com", "org", "x.org", "net.", "", "a..net", "xnet"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/1?q=/en/", "#/en/", "?x=://y"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "x://y://z/fr/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filters.judge(pages, url_filters.rule_table(spark)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[1:] if fit else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark)).count() == 0


def test_many_nested_rules_and_partitions(spark):
    r = random.Random(3)
    labels = ["a", "b", "c-", "d0"]
    rules = {(".".join(r.choices(labels, k=r.randint(1, 4))), r.choice(["/", "/x", "/x/y"]), r.choice(["allow", "block"])) for _ in range(80)}
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"s://{'.'.join(r.choices(labels, k=r.randint(1, 5)))}{r.choice(['', '/', '/x', '/x/y/z'])}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for row in url_filters.judge(pages, url_filters.rule_table(spark, rules), default="none").collect():
        fit = [(len(h + p), len(h), v) for h, p, v in rules if (row.host == h or row.host.endswith("." + h)) and row.path.startswith(p)]
        assert row.verdict == (max(fit)[2] if fit else "none"), row


def test_quality_measures(docs, prose):
    texts = [None, "", " \t\n", "a b c", "a b c a b c", "x\u00a0y z", "one\ntwo\none\n\n", "# * | <b> #", prose(1, 60) + " " + prose(1, 60), prose(2, 3000), "ab " * 500]
    rows = {r.doc_id: r for r in quality_rules.judge(docs(enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(words) < 1000 else None
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        if again is not None:
            assert r.n_repeat_words == len(again)
            assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert rows[9].kept and not rows[0].kept


LOOSE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


def loose_spans(text):
    out = []
    for rank, (kind, p) in enumerate(LOOSE.items()):
        for m in re.finditer(p, text or ""):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in s.split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_against_plain_patterns(docs):
    r = random.Random(5)
    alphabet = ["a", "Z", ".", "@", "-", "_", "+", " ", "(", ")", "\n", "é", "😀", "0", "1", "9", "255", "256", "4539148803436467", "1.2.3.4", "x@y.z"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(800)]
    texts += [None, "", "1" * 30_000, "1 " * 20_000, "a@b" + ".c" * 9_000, "x" * 60_000, "+1 (234) 555-6789 " * 700]
    rows = pii.base_spans(docs(enumerate(texts))).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()
    for row in rows:
        assert row.s == loose_spans(texts[row.doc_id]), texts[row.doc_id][:80]


def test_columns_with_names_of_helpers_pass_through(spark):
    names = ["tokens", "_row", "_wide", "_own0", "base", "n_ip", "text"]
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, "mail a@b.co"), (7, 8, 9, 10, 11, 12, None)], ", ".join(f"`{n}` {'string' if n == 'text' else 'int'}" for n in names))
    out = pii.find(df)
    assert out.columns == ["tokens", "_row", "_wide", "_own0", "text", "n_email", "n_ip", "n_card", "n_phone", "base", "added"]
    rows = {r["tokens"]: r for r in out.collect()}
    assert rows[1][:5] == (1, 2, 3, 4, "mail a@b.co") and rows[1]["n_email"] == 1 and rows[7][:5] == (7, 8, 9, 10, None) and rows[7]["n_email"] == 0


def test_contexts_discover_unseen_identifiers(docs):
    good = [f"call card 453914880343{n:04d} now" for n in range(10_000) if luhn(f"453914880343{n:04d}")][:60]
    texts = [*good, "call card 4539148803436460 now", "about 4539148803436460x trees", None]
    out = pii.find(docs(enumerate(texts))).withColumn("masked", pii.masked()).orderBy("doc_id").collect()
    assert [(x.value, x.start) for x in out[60].added] == [("4539148803436460", 10)]
    assert out[60].masked == "call card [CONTEXT] now" and out[0].masked == "call card [CARD] now" and out[62].masked is None
    assert not out[61].added and out[0].score == "mine"
    assert pii.find(docs([])).count() == 0


def test_masks_join_overlapping_spans(docs):
    text = "a 12.34.56.78@b.org +1 (234) 555-6789"
    row = pii.find(docs([(1, text)])).withColumn("masked", pii.masked()).first()
    assert "12.34" not in row.masked and row.masked.endswith("[PHONE]") and row.masked.startswith("a [")


@pytest.fixture(scope="module")
def labelled(spark, prose):
    r = random.Random(9)
    bad = ["glorkface", "you glorkhead", "YOU GLORKFACE!!", "gl0rkface", "g l o r k f a c e"]
    rows = []
    for i in range(1200):
        text, y = prose(i, 60), int(i % 5 == 0)
        if y:
            words = text.split()
            for _ in range(3):
                words.insert(r.randrange(len(words)), bad[r.choice([0, 0, 0, 1, 1, 2, 3, 4])])
            text = " ".join(words)
        rows.append((i, text, y))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled):
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.learn(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"), ~held)
    out = model.score(labelled.where(held).withColumn("score", F.lit("mine"))).collect()
    right = sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in out)
    assert right >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    odd = model.score(spark.createDataFrame([(1, None), (2, ""), (3, "😀" * 1000)], "doc_id long, text string")).collect()
    assert all(r.score < toxicity.THRESHOLD for r in odd)


def test_toxicity_without_lessons(spark, labelled):
    few = labelled.where("toxic = 0")
    model = toxicity.learn(few.select("doc_id", "text"), few.select("doc_id", "toxic"), F.lit(True))
    assert {r.score for r in model.score(few.limit(5)).collect()} == {0.0}
    none = toxicity.learn(few.select("doc_id", "text"), few.select("doc_id", "toxic").limit(0), F.lit(True))
    assert {r.score for r in none.score(few.limit(5)).collect()} == {0.0}
