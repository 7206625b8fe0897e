"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

1. ``LABELLED`` bounds the labelled rows that are learned from: a fixed share of the ids, by hash, so that a run on
   the same tables learns from the same rows.  Equal texts count once.  They are dealt into three parts by hash.
2. Lexicon, from part one: words and word beginnings that toxic texts hold far more often than others (smoothed odds
   by document).  Tasks count their own rows, a sum joins them, and the strongest ``LEXICON`` entries stay.
3. Trees, from part two: lexicon density, count and weight; hits near a second-person word; capitals; punctuation;
   obfuscation (words spelled with digits or symbols, spaced letters, drawn-out letters), and hits these hide.
4. Isotonic regression, from part three, turns the trees' scores into probabilities.

Scoring is one pass over all whole texts; features are made in Arrow batches, trees and calibration run in the JVM.
Labels, language, source and id are no inputs of a score.

Defined cases: a null text scores as an empty one.  Labels that are null, or disagree for one id, are left out.  With
labels of one class only (or none) every score is the share of toxic labels (or 0).  Extra columns pass through; the
added ones (features, score) replace columns of those names.
"""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.llm.common import cut, ships, slices, table, with_columns_of_text

ships(__name__)

LABELLED = 24_000
LEXICON = 2_000
LEAST_ODDS = 20.0
HEAD = 4  # letters of a word beginning
NEAR = 4  # words between a hit and a second-person word
#: Second-person words of the four languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[0-9@$!*+|€])[\w@$!*+|€-]*[^\W\d_][0-9@$!*+|€._-]+[^\W\d_][\w@$!*+|€-]*")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*][^\W\d_]){2,}(?![^\W_])")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})
_SEPARATORS = re.compile(r"[*._\- ]")
N_FEATURES = 14


def units(text: str) -> set[str]:
    """Words and word beginnings (with a tilde) of a text."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {w[:HEAD] + "~" for w in words if len(w) >= HEAD}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    low = text.lower()
    words = _LETTERS.findall(low)
    kinds = set(words)
    weight = {w: max(lexicon.get(w, 0.0), lexicon.get(w[:HEAD] + "~", 0.0) if len(w) >= HEAD else 0.0) for w in kinds}
    bad = {w: x for w, x in weight.items() if x > 0}
    at = [i for i, w in enumerate(words) if w in bad] if bad else []
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)

    def hidden(word: str) -> bool:
        plain = word.translate(_LEET)
        return any(lexicon.get(w, 0) > 0 or lexicon.get(w[:HEAD] + "~", 0) > 0 for w in (_SEPARATORS.sub("", plain), *_LETTERS.findall(plain)) if len(w) >= HEAD)

    masked, spaced = _MASKED.findall(low), _SPACED.findall(low)
    drawn = [w for w in kinds if _DRAWN.search(w)]
    covert = sum(map(hidden, masked)) + sum(map(hidden, spaced)) + sum(
        any(lexicon.get(w, 0) > 0 or lexicon.get(w[:HEAD] + "~", 0) > 0 for w in (_DRAWN.sub(r"\1", x), _DRAWN.sub(r"\1\1", x))) for x in drawn)
    n, size = max(len(words), 1), max(len(text), 1)
    runs = text.split()
    return [
        len(at) / n, math.log1p(len(at)), sum(bad[words[i]] for i in at) / n, float(len(bad)), max(bad.values(), default=0.0),
        near / n, math.log1p(near), sum(map(str.isupper, text)) / size, sum(map(str.isupper, runs)) / max(len(runs), 1),
        (text.count("!") + text.count("?")) / size, (len(masked) + len(spaced) + len(drawn)) / n, math.log1p(covert), covert / n,
        math.log1p(n),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON entries

    def work(part):
        rows = [features(t or "", sent.value) for t in part.column(text).to_pylist()]
        return [pa.array(rows, pa.list_(pa.float64()))]

    return with_columns_of_text(docs, "features array<double>", work, text)


def learned_lexicon(rows: DataFrame) -> dict[str, float]:
    """Unit to log odds, from (text, toxic) rows."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for part in slices(batch):
                for t, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    (toxic if y else clean).update(units(t or ""))
                    (toxic if y else clean)["\n"] += 1  # the number of texts
        if toxic or clean:
            names = list(toxic.keys() | clean.keys())
            for a in range(0, len(names), 50_000):
                some = names[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array([toxic[x] for x in some], pa.int64()), pa.array([clean[x] for x in some], pa.int64())], names=["unit", "p", "n"])

    counts = cut(rows.select("text", "toxic").mapInArrow(run, "unit string, p bigint, n bigint").groupBy("unit").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "units")
    whole = counts.where(F.col("unit") == "\n").first()
    if whole is None or not whole["p"] or not whole["n"]:
        return {}
    odds = F.log((F.col("p") + 0.5) / (whole["p"] + 1)) - F.log((F.col("n") + 0.5) / (whole["n"] + 1))
    best = counts.where(F.col("unit") != "\n").where(F.col("p") >= max(3, whole["p"] // 100)).withColumn("w", odds).where(F.col("w") >= math.log(LEAST_ODDS))
    return {r["unit"]: r["w"] for r in best.orderBy(F.desc("w"), "unit").limit(LEXICON).collect()}


class Model:
    """Lexicon, trees and calibration; or a constant score where the labels could not teach more."""

    def __init__(self, lexicon: dict, trees=None, curve=None, constant: float = 0.0):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds features and score."""
        out = with_features(docs.drop("score"), self.lexicon, text)
        if self.trees is None:
            return out.withColumn("score", F.lit(float(self.constant)))
        raw = _raw(self.trees, out)
        return self.curve.setFeaturesCol("_raw").setPredictionCol("score").transform(raw).drop("_raw").withColumn(
            "score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def _raw(trees, rows: DataFrame) -> DataFrame:
    """Adds the trees' probability; their other columns go."""
    hidden = trees.setFeaturesCol("_vector").setPredictionCol("_predicted").setRawPredictionCol("_margin").setProbabilityCol("_probability")
    out = hidden.transform(rows.withColumn("_vector", array_to_vector("features")))
    return out.withColumn("_raw", vector_to_array("_probability")[1]).drop("_vector", "_predicted", "_margin", "_probability")


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id: str = "doc_id", text: str = "text", most: int = LABELLED) -> Model:
    """A model from at most about ``most`` labelled rows for which ``allowed`` (a condition on the id) holds."""
    marks = labels.where(allowed).groupBy(id).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select(id, "toxic")
    n = marks.count()
    part = F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit(5)), F.lit(1_000_000))
    marks = marks.where(part < int(1_000_000 * min(1.0, most / max(n, 1))))
    rows = docs.select(id, text).join(F.broadcast(marks), id)  # bounded by ``most``
    rows = rows.withColumn("hash", F.xxhash64(text)).dropDuplicates(["hash"]).select(F.col(text).alias("text"), F.col("toxic").cast("double"), F.pmod("hash", F.lit(10)).alias("part"))
    rows = cut(rows.repartition(max(1, min(64, n // 500))), "labelled")
    lexicon = learned_lexicon(rows.where("part < 5"))
    fit = cut(with_features(rows.where("part >= 5"), lexicon), "features").withColumnRenamed("toxic", "label")
    classes = fit.groupBy(F.col("part") < 8).agg(F.min("label").alias("a"), F.max("label").alias("b")).collect()
    if not lexicon or len(classes) < 2 or any(c["a"] == c["b"] for c in classes):
        mean = rows.agg(F.avg("toxic")).first()[0]
        return Model(lexicon, constant=mean or 0.0)
    trees = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=7).fit(
        fit.where("part < 8").select("label", array_to_vector("features").alias("_vector")))
    curve = IsotonicRegression(featuresCol="_raw", labelCol="label").fit(_raw(trees, fit.where("part >= 8")).select("label", "_raw"))
    return Model(lexicon, trees, curve)


def held_out(id: Column) -> Column:
    return F.crc32(id.cast("string")) % 4 == 2


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str, text: str = "text") -> DataFrame:
    """``docs`` with score, by a model of the labelled rows of the tables that are not held out."""
    model = learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return model.score(docs, text)


THRESHOLD = 0.3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
