"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features come from one Arrow pass over the texts; the trees, the calibration and the
scoring run in Spark's ML library.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.common import stored

#: Insults that need no training rows; what the labels add is learned.
SEED_LEXICON = frozenset("idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting clown imbecile cretin vermin filth pig bastard fool hate kill".split())
#: Forms of address of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
FEATURES = (
    "log_words", "learned_density", "learned_log_count", "seed_density", "seed_log_count", "best_weight", "second_person_density",
    "nearness", "near_count", "capitals", "shouted_words", "exclamations", "questions", "punctuation", "repeated_marks", "obfuscated", "obfuscated_hits", "longest_run",
)
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!|0-9'’.-]+[^\W_]+)*")
_PLAIN = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"([!?*#$%&@])\1+")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
NEAR = 6


@dataclass(frozen=True)
class Model:
    """A fitted scorer: the learned word weights, the trees and the calibration; ``rate`` alone where nothing can be learned."""

    weights: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def features(text: str | None, weights: dict[str, float]) -> list[float]:
    """The dense features of one whole text; null and empty texts give zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    words = _TOKEN.findall(text)
    n, size = max(1, len(words)), len(text)
    learned, seeds, best, odd, odd_hits, shouted = 0, 0, 0.0, 0, 0, 0
    persons: list[int] = []
    hits: list[int] = []
    for i, raw in enumerate(words):
        word = raw.lower()
        if not raw.isalpha():
            plain = word.translate(LEET).replace("*", "").replace("-", "").replace(".", "").replace("'", "").replace("’", "")
            if any(c.isalpha() for c in word) and not word.isalpha() and plain != word and not word.isdigit():
                odd += 1
                odd_hits += plain in weights or plain in SEED_LEXICON
            word = plain
        if word in weights:
            learned += 1
            best = max(best, weights[word])
            hits.append(i)
        if word in SEED_LEXICON:
            seeds += 1
            if word not in weights:
                hits.append(i)
        if word in SECOND_PERSON:
            persons.append(i)
        if len(raw) > 2 and raw.isupper():
            shouted += 1
    nearest, near = 0.0, 0
    if persons and hits:
        p, h = np.array(persons), np.array(hits)
        at = np.searchsorted(p, h)
        gap = np.minimum(np.abs(h - p[np.minimum(at, len(p) - 1)]), np.abs(h - p[np.maximum(at - 1, 0)]))
        nearest, near = 1 / (1 + float(gap.min())), int((gap <= NEAR).sum())
    capitals = sum(map(str.isupper, text))
    marks = sum(text.count(c) for c in ".,;:!?*#$%&@")
    longest = max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)
    return [
        float(np.log1p(len(words))), learned / n, float(np.log1p(learned)), seeds / n, float(np.log1p(seeds)), best, len(persons) / n,
        nearest, float(np.log1p(near)), capitals / size, shouted / n, text.count("!") / n, text.count("?") / n, marks / size,
        len(_MARKS.findall(text)) / n, odd / n, float(np.log1p(odd_hits)), float(min(longest, 20)),
    ]


def _dense(weights: dict[str, float]):
    """The features as an Arrow function of a column of texts."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, weights) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def _lexicon(labelled: DataFrame, positives: int, negatives: int) -> dict[str, float]:
    """Words whose share of toxic texts is surely higher: log odds by documents, less four standard errors, above log 2. The sample bounds how many there are."""
    words = labelled.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("all")).where("bad >= 3")
    b, g = F.col("bad") + 0.5, F.col("all") - F.col("bad") + 0.5
    odds = F.log(b / (positives + 1)) - F.log(g / (negatives + 1))
    sure = odds - 4 * F.sqrt(1 / b + 1 / g)
    found = counts.withColumn("odds", odds).withColumn("sure", sure).where(f"sure > {np.log(2)} or (bad >= 5 and all = bad)")
    return {r.word: float(r.odds) for r in found.collect()}


def fit(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = 20_000,
    trees: int = 20,
    depth: int = 3,
    seed: int = 7,
) -> Model:
    """Fit on a bounded sample: the ``most_rows`` labelled ids with the smallest hash (all, if fewer).

    ``usable`` (on ``id_col`` of ``labels``) says which ids may be learned from. Four fifths of the
    sample fit the words and the trees, one fifth the calibration. Null ids and labels are left
    out; an id labelled twice counts once, as toxic if any of its labels says so. Without
    labelled rows, or with one class alone, the model is that class's constant rate (0 without rows).
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        ids = ids.where(usable)
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    # at most most_rows small rows: bounded, hence broadcast
    picked = stored(spark, ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most_rows), "picked")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample = stored(spark, texts.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(5)) == 0).repartition(parts, "id"), "sample")
    count = {(r.calibrates, int(r.label)): r["count"] for r in sample.groupBy("calibrates", "label").count().collect()}
    fits, total = [count.get((False, k), 0) for k in (0, 1)], sum(count.values())
    if not min(fits):
        return Model({}, None, None, sum(v for (_, k), v in count.items() if k) / total if total else 0.0)
    weights = _lexicon(sample.where("not calibrates"), fits[1], fits[0])
    dense = stored(spark, sample.select("label", "calibrates", _dense(weights)("text").alias("dense")), "dense").withColumn("features", array_to_vector("dense"))
    learner = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=seed, maxBins=32)
    model = learner.fit(dense.where("not calibrates").select("features", "label").coalesce(4))
    held = dense.where("calibrates")
    if not held.isEmpty():
        raw = model.transform(held.select("features", "label")).select("label", vector_to_array("probability")[1].alias("raw"))
        return Model(weights, model, IsotonicRegression(labelCol="label", featuresCol="raw").fit(raw), 0.0)
    return Model(weights, model, None, 0.0)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each row, 0 to 1, in column ``into`` (replaced if there).

    Null and empty texts have the features of no words. Repeated rows are each scored. No row is
    moved: texts are read where they are.
    """
    if model.trees is None:
        return docs.withColumn(into, F.lit(float(model.rate)))
    # the row travels as one column, so that no name in it can clash with the trees' columns
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), array_to_vector(_dense(model.weights)(docs[text_col])).alias("features"))
    out = model.trees.transform(rows).select("row", vector_to_array("probability")[1].alias("raw"))
    if model.calibration is not None:
        out = model.calibration.transform(out).select("row", F.col("prediction").alias("raw"))
    return out.withColumn("bounded", F.least(F.greatest("raw", F.lit(0.0)), F.lit(1.0))).select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != into.lower()], F.col("bounded").alias(into))


def rejected(score_col: str = "toxicity", least: float = 0.5) -> Column:
    return F.col(score_col) >= least
