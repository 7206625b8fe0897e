"""Personal data: base spans by fixed patterns, and a bootstrapped contextual extraction that adds unseen identifiers.

Base spans (email, ip, card, phone) come from four regular expressions with their checks.  They are the seeds.

1. Instances: every identifier-like token (a run without blanks that holds a digit, at least four characters once
   punctuation around it is cut) with its lexical context, the word before and its own shape (letters, digits and
   other characters, runs squeezed), and every seed with the same context.
2. Patterns: contexts that occur with seeds, or with instances already held.  Spark scores the bipartite graph of
   patterns and instances in ``ROUNDS`` rounds: a pattern's confidence is the share of its distinct instances that
   are known, weighed by their own confidence; an instance's is the noisy-or of the patterns it occurs with.
3. Patterns with at least ``SUPPORT`` known instances and ``CONFIDENCE`` are kept.  Identifiers that were not seen as
   seeds and whose confidence comes from kept patterns are added as spans of kind ``context``, unless they overlap a
   base span.

Everything is built-in functions.  Instances are counted by (pattern, instance) in the map tasks before any shuffle,
so a pattern or an identifier that a third of all texts hold is one row for each task, and only the graph of
distinct pairs is iterated, each round a written table.

Offsets count code points.  Positions are sums over the pieces between matches, built in blocks of the square root of
their number, so that a text with very many matches does not cost the square of it.

Defined cases: a null text has no spans; equal rows have equal spans; extra columns pass through, those named n_email,
n_ip, n_card, n_phone, base or added are replaced.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.llm.common import ascii_lower, cut, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, CONFIDENCE = 3, 20, 0.9
# Equal to the plain patterns, written so that no match needs deep recursion or looks at a run of characters twice.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_TOKEN = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def holds(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def sums_before(xs: Column) -> Column:
    """For each number of an array, the sum of those before it."""
    total = lambda ys: F.aggregate(ys, F.lit(0).cast("int"), lambda a, y: a + y)
    prefix = lambda ys: F.aggregate(
        ys, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).cast("int").alias("sum")),
        lambda a, y: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + y).alias("sum")))["out"]
    size = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
    blocks = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda k: F.slice(xs, k * size + 1, size)))
    starts = prefix(F.transform(blocks, total))
    return F.coalesce(F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(prefix(b), lambda x: x + s))), F.array().cast("array<int>"))


def with_matches(docs: DataFrame, patterns: dict[str, str], text: Column, some: Column) -> DataFrame:
    """Adds, for each name, the matches (value, start in code points) of its pattern in rows where ``some`` holds.

    Each step is a column of its own, so that no pattern runs twice over a text.
    """
    none = F.array().cast("array<string>")
    out = docs.withColumns({f"_{k}_m": F.when(some, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    out = out.withColumns({f"_{k}_p": F.when(F.size(f"_{k}_m") > 0, F.split(text, p, -1)).otherwise(none) for k, p in patterns.items()})
    sized = lambda k: F.transform(f"_{k}_m", lambda m, i: (F.length(m) + F.length(F.get(f"_{k}_p", i))).cast("int"))
    placed = lambda k: F.transform(f"_{k}_m", lambda m, i: F.struct(
        m.alias("value"), (F.get(f"_{k}_s", i) + F.length(F.get(f"_{k}_p", i))).alias("start")))
    out = out.withColumns({f"_{k}_n": sized(k) for k in patterns})
    out = out.withColumns({f"_{k}_s": sums_before(F.col(f"_{k}_n")) for k in patterns})
    out = out.withColumns({k: placed(k) for k in patterns})
    return out.drop(*[f"_{k}_{x}" for k in patterns for x in "mpns"])


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone and base: spans (start, rank, kind, end, value) in their order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = with_matches(docs, {f"_{k}": p for k, p in PATTERNS.items()}, whole, whole.rlike("[0-9@]"))  # no base span lacks both
    spans = lambda i, k: F.transform(F.filter(f"_{k}", lambda x: holds(k, x["value"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(i).alias("rank"), F.lit(k).alias("kind"),
        (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))
    out = out.withColumn("base", F.sort_array(F.concat(*[spans(i, k) for i, k in enumerate(KINDS)]))).drop(*[f"_{k}" for k in KINDS])
    of_kind = lambda k: F.filter("base", lambda x: x["kind"] == k)
    return out.withColumns({f"n_{k}": F.size(of_kind(k)).cast("long") for k in KINDS})


def shape(value: Column) -> Column:
    """Character classes of a token: letter runs, digit runs of one or two, up to eight, or more; mixtures are one x."""
    out = F.regexp_replace(value, r"\p{L}+", "a")
    for digits, mark in ((r"[0-9]{9,}", "N"), (r"[0-9]{3,8}", "n"), (r"[0-9]{1,2}", "d")):
        out = F.regexp_replace(out, digits, mark)
    return F.substring(F.regexp_replace(out, r"[aNnd]{2,}", "x"), 1, 24)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens: identifier-like tokens (value, start, left) of the text, those inside base spans too."""
    whole = F.coalesce(F.col(text), F.lit(""))
    wide = rf"(?:(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]{{1,40}}[\x20\x09-\x0D]{{1,3}})?(?:(?<![^\x20\x09-\x0D])|\G){_TOKEN}"
    out = with_matches(docs, {"_wide": wide}, whole, whole.rlike("[0-9]"))

    def parts(x):
        left = F.regexp_extract(x["value"], r"^[^\x20\x09-\x0D0-9]*(?=[\x20\x09-\x0D])", 0)
        before = F.regexp_extract(x["value"], r"^(?:[^\x20\x09-\x0D0-9]*[\x20\x09-\x0D]+)?[^\p{L}\p{N}+]*", 0)
        value = F.regexp_replace(F.substring(x["value"], F.length(before) + 1, F.length(x["value"])), r"[^\p{L}\p{N}]+$", "")
        return F.struct(
            value.alias("value"), (x["start"] + F.length(before)).alias("start"),
            F.regexp_replace(ascii_lower(left), r"^[^\p{L}\p{N}=:#]+|[^\p{L}\p{N}=:#]+$", "").alias("left"))

    return out.withColumn("tokens", F.filter(F.transform("_wide", parts), lambda t: F.length(t["value"]) >= 4)).drop("_wide")


def graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, seed, n): distinct pairs of the corpus, seed where the instance is part of a base span."""
    inside = lambda t: F.exists("base", lambda b: (t["start"] < b["end"]) & (t["start"] + F.length(t["value"]) > b["start"]))
    rows = found.select(F.explode(F.transform("tokens", lambda t: F.struct(
        pattern(t).alias("pattern"), t["value"].alias("instance"), inside(t).alias("seed")))).alias("t")).select("t.*")
    return rows.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def pattern(t: Column) -> Column:
    return F.concat(t["left"], F.lit(" "), shape(t["value"]))


def bootstrapped(pairs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Kept patterns (pattern, confidence) and discovered identifiers (instance, confidence)."""
    known = pairs.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    pairs, known, patterns = cut(pairs, "pairs"), cut(known, "known"), None
    for _ in range(rounds):
        rated = pairs.join(known, "instance").groupBy("pattern").agg(
            F.avg("score").alias("confidence"), F.sum("score").alias("support"))
        patterns = cut(rated.where((F.col("support") >= support) & (F.col("confidence") >= confidence)), "patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        heard = pairs.join(patterns, "pattern").groupBy("instance").agg((1 - doubt).alias("heard"))
        known = cut(known.join(heard, "instance", "left").select("instance", F.greatest("score", F.coalesce("heard", F.lit(0.0))).alias("score")), "known")
    seeds = pairs.where("seed").select("instance").distinct()
    return patterns, known.where(F.col("score") >= confidence).join(seeds, "instance", "left_anti").withColumnRenamed("score", "confidence")


def find(docs: DataFrame, text: str = "text", keep_text: bool = True, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Adds n_email .. n_phone, base and added (spans of discovered identifiers: start, end, value).

    What the patterns found is written once, and read for the graph and for the result; without ``keep_text`` the text
    itself is not written and not returned.  The columns of ``docs`` are hidden while the work goes on, so they may have
    any names; those named like an added column are replaced.
    """
    made = [*[f"n_{k}" for k in KINDS], "base", "added"]
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c == text or c not in made}
    hidden = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    found = candidates(base_spans(hidden, own[text]), own[text])
    found = found.withColumn("_row", F.monotonically_increasing_id())
    found = cut(found if keep_text else found.drop(own[text]), "spans")
    _, unseen = bootstrapped(graph(found), rounds, support, confidence)
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (t["start"] + F.length(t["value"]) > b["start"])))
    asked = found.select("_row", F.explode(free).alias("t")).select("_row", "t.value", "t.start").join(unseen.withColumnRenamed("instance", "value"), "value")
    spans = asked.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.length("value")).alias("end"), "value"))).alias("added"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    out = found.join(spans, "_row", "left").withColumn("added", F.coalesce("added", none))
    return out.select(*[F.col(n).alias(c) for c, n in own.items() if keep_text or c != text], *made)


def masked(text: str = "text") -> Column:
    """The text of rows of ``find`` with each span replaced by its kind in brackets; spans that overlap are one."""
    marks = F.sort_array(F.concat(
        F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))),
        F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("context").alias("kind")))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def merge(a, x):
        last = F.try_element_at(a, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(last["end"] > x["start"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(wider))).otherwise(F.concat(a, F.array(x)))

    merged = F.aggregate(marks, none, merge)
    part = lambda a, b: F.substring(F.col(text), a + 1, b - a)
    pieces = F.transform(merged, lambda x, i: F.concat(
        part(F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    rest = F.substring(F.col(text), F.try_element_at(merged, F.lit(-1))["end"] + 1, F.length(F.col(text)))
    return F.when(F.size("base") + F.size("added") == 0, F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), rest))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    added = F.transform("added", lambda x: F.struct(
        x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("context").alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", added))).alias("spans"))
