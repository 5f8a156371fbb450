"""The corpus pipeline, stage by stage."""

import random

import corpus_pipeline as P
from outlay.llm.common import stored

FILLER = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
BAD = "idiot scum worthless".split()


def write(spark, folder):
    rng = random.Random(1)
    item = " ".join(rng.choices(FILLER, k=25))
    docs, labels, kinds = [], [], {}
    for i in range(700):
        words = rng.choices(FILLER, k=rng.randrange(20, 90))
        kind = "clean"
        if i % 6 == 1:
            kind = "toxic"
            words[3:3] = [rng.choice(BAD), "you", rng.choice(BAD)]
        elif i % 20 == 2:
            kind = "leak"
            words[5:5] = item.split()
        elif i % 20 == 4:
            kind = "copy"
            words = docs[-1][1].split() if kinds[i - 1] == "clean" else words
            kind = "copy" if kinds[i - 1] == "clean" else "clean"
        kinds[i] = kind
        docs.append((i, " ".join(words), "en", f"s{i % 5}", 1))
        if i % 2:
            labels.append((i, 1, int(kind == "toxic")))
    docs += [(700, None, None, None, None), (701, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, kinds


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, kinds = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r[0] for r in rows}
    for name, stage in P.STAGES:
        before = docs
        docs = stored(spark, stage(spark, docs, folder), name)
        if name != "sharding":
            assert docs.columns == before.columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            drop = {"toxicity": "toxic", "near_dedup": "copy", "decontamination": "leak"}[name]
            left -= {i for i in left if kinds.get(i) == drop}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == left
    out = docs.collect()
    assert {r.doc_id for r in out} <= left
    assert {r.shard for r in out} <= set(range(P.SHARDS))
    assert P.run(spark, folder).count() == len(out)


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert P.run(spark, folder).count() == 0


def test_columns_with_clashing_names(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS toxicity", "2 AS size", "3 AS copies", "4 AS features", "5 AS kept", "6 AS target", "7 AS source_size")
    for name, stage in P.STAGES[:-1]:
        after = stored(spark, stage(spark, docs, folder), name)
        assert after.columns == docs.columns, name
        docs = after
