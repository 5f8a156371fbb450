"""Quality: held-out accuracy and the defined results of odd rows."""

import random

from outlay.llm import quality as X
from outlay.llm import queries as Q
from pyspark.sql import functions as F

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l m".split()]


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = rng.choices(WORDS, k=rng.randrange(5, 200))
        text = " ".join(words).capitalize() + "." if good else rng.choice(["!! ", " $$$ ", " | "]).join(words).upper()
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def auc(pairs):
    good, bad = ([s for y, s in pairs if y == k] for k in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(random.Random(1), 1500)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(0, None), (None, 1), (1, labels[1][1])], "doc_id long, quality int")
    model = X.fit(spark, table, marks, F.col("doc_id") % 5 != 0)
    truth = dict(labels)
    scored = X.score(table, model).collect()
    held = [(truth[r.doc_id], r.quality) for r in scored if r.doc_id % 5 == 0]
    assert all(0 <= r.quality <= 1 for r in scored)
    assert auc(held) >= 0.97 and sum(y == (s >= 0.3) for y, s in held) >= 0.95 * len(held)

    odd = [(None, None), (1, ""), (1, ""), (2, "ban cer " * 100_000), (3, " \t\n"), (4, "👍" * 10), (4, "👍" * 10)]
    rows = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS raw_difference", "2 AS Quality", "'x' AS row")
    out = X.score(rows, model)
    assert out.columns == ["doc_id", "text", "raw_difference", "row", "quality"]
    got = out.collect()
    assert len(got) == len(odd) and all(0 <= r.quality <= 1 for r in got) and all(r.raw_difference == 1 for r in got)
    assert len({r.quality for r in got if r.text in (None, "")}) == 1 and len({r.quality for r in got if r.doc_id == 4}) == 1


def test_pieces_cover_the_whole_text():
    text = "é" * 1000 + "x"
    assert b"".join(X.pieces(text)) == text.encode() and X.pieces(None) == X.pieces("") == []
    sizes = X.Sizes(b"abcdefgh" * 40, b"12345678" * 40)
    assert sizes.difference("abcdefgh" * 50) > 0 > sizes.difference("12345678" * 50) and sizes.difference("") == sizes.difference(None) == 0
    # what stands at the end of a long text counts
    assert sizes.difference("zq" * 2000 + "12345678" * 300) < sizes.difference("zq" * 2000)


def test_calibration_rises_everywhere():
    x, y = X._rising([-0.5, -0.25, 0.0, 0.25, 0.5], [0.0, 0.0, 0.5, 1.0, 1.0])
    assert (x, y) == ([-1.0, -0.375, 0.0, 0.375, 1.0], [0.0, X.ENDS, 0.5, 1 - X.ENDS, 1.0])
    assert X._rising([], []) == ([-1.0, 1.0], [0.0, 1.0])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = X.fit(spark, docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.quality for r in X.score(docs, none).collect()] == [0.0, 0.0]
    one = X.fit(spark, docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert [r.quality for r in X.score(docs, one).collect()] == [1.0, 1.0]
    assert X.score(docs.limit(0), none).count() == 0


def test_little_to_learn_from(spark):
    docs, labels = corpus(random.Random(3), 30)
    table, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert all(0 <= r.quality <= 1 for r in X.score(table, X.fit(spark, table, marks)).collect())
    assert X.fit(spark, table, marks, most_rows=5) is not None


def test_query_on_held_out_labels(spark):
    at = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").where("quality IS NOT NULL").collect()}
    rows = Q.queries()["op11_quality"](spark, at).collect()
    held = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    a, right, kept = auc([(y, s) for y, s, _ in held]), sum(y == p for y, _, p in held) / len(held), sum(p for y, _, p in held if y) / sum(y for y, *_ in held)
    print(f"op11_quality held out: {len(held)} rows, AUC {a:.4f}, accuracy {right:.4f}, good kept {kept:.4f}")
    assert len(rows) == spark.read.parquet(f"{at}/documents.parquet").count() and a >= 0.97 and right >= 0.95 and kept >= 0.97
