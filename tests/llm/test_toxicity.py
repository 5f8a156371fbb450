"""Toxicity: held-out accuracy and the defined results of odd rows."""

import random

from outlay.llm import toxicity as X
from pyspark.sql import functions as F

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l m".split()]
BAD = "grutz blarg snoot".split()


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = rng.choices(WORDS, k=rng.randrange(5, 60))
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    docs, labels = corpus(rng, 1500)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(0, None), (None, 1), (1, labels[1][1])], "doc_id long, toxic int")
    model = X.fit(spark, table, marks, F.col("doc_id") % 5 != 0)
    assert set(BAD) <= set(model.weights)
    truth = dict(labels)
    scored = X.score(table, model).collect()
    held = [(truth[r.doc_id], r.toxicity >= 0.5) for r in scored if r.doc_id % 5 == 0]
    assert all(0 <= r.toxicity <= 1 for r in scored)
    assert sum(a == b for a, b in held) >= 0.97 * len(held)

    odd = [(None, None), (1, ""), (1, ""), (2, "grutz " * 50_000), (3, " \t\n"), (4, "👍" * 10), (5, "gr*tz! YOU grutz!!!")]
    rows = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS features", "2 AS prediction", "'x' AS raw", "3 AS toxicity", "4 AS row")
    out = X.score(rows, model)
    assert out.columns == ["doc_id", "text", "features", "prediction", "raw", "row", "toxicity"]
    got = out.collect()
    assert len(got) == len(odd) and all(0 <= r.toxicity <= 1 for r in got)
    assert {r.toxicity for r in got if r.text in (None, "")} == {got[1].toxicity}
    assert next(r.toxicity for r in got if r.doc_id == 5) > 0.5


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = X.fit(spark, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.toxicity for r in X.score(docs, none).collect()] == [0.0, 0.0]
    one = X.fit(spark, docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert [r.toxicity for r in X.score(docs, one).collect()] == [1.0, 1.0]
    assert X.score(docs.limit(0), none).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = corpus(random.Random(2), 400)
    table, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert X.fit(spark, table, marks, most_rows=100).trees is not None


def test_features():
    f = dict(zip(X.FEATURES, X.features("You IDIOT!!! grutz 1d1ot, you", {"grutz": 3.0}), strict=True))
    assert f["best_weight"] == 3.0 and f["second_person_density"] == 2 / 5 and f["nearness"] == 0.5
    assert f["shouted_words"] == 1 / 5 and f["obfuscated"] == 1 / 5 and f["obfuscated_hits"] > 0 and f["exclamations"] == 3 / 5
    assert X.features(None, {}) == X.features("", {}) == [0.0] * len(X.FEATURES)


def test_query_on_held_out_labels(spark):
    from outlay.llm import queries as Q

    at = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").where("toxic IS NOT NULL").collect()}
    held = [(truth[r.doc_id], r.score, r.predicted) for r in Q.queries()["op2_toxicity"](spark, at).collect() if r.held_out and r.doc_id in truth]
    bad, good = ([s for y, s, _ in held if y == k] for k in (1, 0))
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    hits = sum(p for y, _, p in held if y)
    f1 = 2 * hits / (sum(p for *_, p in held) + len(bad))
    print(f"op2_toxicity held out: {len(held)} rows, {len(bad)} toxic, AUC {auc:.4f}, F1 {f1:.4f}")
    assert auc >= 0.9 and f1 >= 0.8
