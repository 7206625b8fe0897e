"""Quality rules: a table of thresholds over counts and ratios of a text, compiled into Spark projections.

``measures`` adds the counts, ``compiled`` turns a table of thresholds into one column that lists the rules a row
breaks, ``judge`` joins both.  All are built-in expressions; no row leaves the JVM and nothing is shuffled.

Words are runs without the six ASCII blanks.  Three-word windows are compared by 64-bit hashes, sorted with their
places, so a text of n words costs n log n.  Two different windows of a text of a million words would share a hash
with a chance of about 3e-8.

Defined cases: a null text has no words and breaks the rules as an empty one does.  Ratios of nothing are null and
break no rule.  Extra columns pass through; added columns replace those of their names.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.llm.common import ascii_lower, table

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "was", "on", "are", "this", "it", "be", "at", "by", "an", "or",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "nicht", "ein", "eine", "sich", "auf", "dem", "des", "als",
    "le", "la", "les", "et", "de", "un", "une", "du", "en", "que", "qui", "dans", "est", "pour", "par", "sur", "pas", "au",
    "el", "los", "las", "y", "se", "del", "con", "por", "es", "una", "su", "al", "lo", "para")
#: (ratio, least, most), null for no bound.  A ratio outside breaks the rule of its name.
THRESHOLDS = (
    ("mean_word_length", 2.0, 25.0),
    ("symbols_per_word", None, 0.5),
    ("stop_word_share", 0.02, None),
    ("duplicate_line_share", None, 0.5),
    ("one_word_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.5),
)
MIN_WORDS, MOST_REPEATED = 50, 50


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts behind the ratios."""
    blank = r"[\x20\x09-\x0D]+"
    words, lines, grams = F.col("_words"), F.col("_lines"), F.col("_grams")
    whole = F.coalesce(F.col(text), F.lit(""))
    first = docs.withColumns({
        "_words": F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
        "_lines": F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace(whole, blank, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    stop = ascii_lower(F.array_join(words, " "))
    second = first.withColumns({
        "n_words": F.size(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_one_word_lines": F.size(F.filter(lines, lambda x: ~F.trim(x).rlike(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
        "n_stop_words": F.regexp_count(stop, F.lit(r"(?<![^ ])(?:" + "|".join(STOP_WORDS) + r")(?=[ .,;:!?]|$)")).cast("long"),
        "_grams": F.sort_array(F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")))),
    })
    again = F.filter(grams, lambda x, i: (x["h"] == F.get(grams, i - 1)["h"]) | (x["h"] == F.get(grams, i + 1)["h"]))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    return second.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).drop("_words", "_lines", "_grams")


def ratios() -> dict[str, Column]:
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return {
        "mean_word_length": part("word_chars", "n_words"), "symbols_per_word": part("n_symbols", "n_words"),
        "stop_word_share": part("n_stop_words", "n_words"), "duplicate_line_share": part("n_dup_lines", "n_lines"),
        "one_word_line_share": part("n_one_word_lines", "n_lines"), "ellipsis_line_share": part("n_ellipsis_lines", "n_lines"),
    }


def compiled(thresholds=THRESHOLDS) -> Column:
    """Names of the rules that a row of ``measures`` breaks."""
    of = ratios()
    broken = [F.when((of[n] < low if low is not None else F.lit(False)) | (of[n] > high if high is not None else F.lit(False)), F.lit(n))
              for n, low, high in thresholds]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Adds the measures, base_failed, broken (rules of the table) and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = measures(docs, text).withColumns({"base_failed": failed, "broken": compiled(thresholds)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM doc),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM parts),
gram AS (SELECT doc_id, i, w, lead(w) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM gram WHERE w3 IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
m AS (SELECT p.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols,
   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
   len(list_filter(lines, lambda x: NOT regexp_matches(trim(x, ' '), '[\x20\x09-\x0D]'))) AS n_one,
   len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_dots,
   len(list_filter(words, lambda x: list_contains(['""" + "','".join(STOP_WORDS) + r"""'],
       regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^([^.,;:!?]*)[.,;:!?].*$', '\1', 's')))) AS n_stop
   FROM parts p LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
   NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 25 AND n_symbols / n_words <= 0.5 AND n_stop / n_words >= 0.02
   AND n_dup_lines / n_lines <= 0.5 AND n_one / n_lines <= 0.9 AND n_dots / n_lines <= 0.5, false) AS kept FROM j
"""
