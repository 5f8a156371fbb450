"""Models as plug-ins: batches, failures, time limits, caps, dry runs, stored vectors."""

import json
import time

import pytest

from outlay.operators import models
from outlay.plans import hooks


def stand_ins():
    """Made inside a function, so that workers get them by value."""

    def broken():
        def ask(items):
            raise RuntimeError("away")

        return ask

    def slow():
        def ask(items):
            time.sleep(2)
            return "[]"

        return ask

    def odd():
        return lambda items: json.dumps(["x", {"transaction_id": items[0]["transaction_id"], "internal_category_l1": 5, "confidence": "high"}, {"transaction_id": items[1]["transaction_id"], "internal_category_l1": "IT", "confidence": 3}])

    return {"broken": broken, "babbling": lambda: lambda items: "I'd say IT", "no list": lambda: lambda items: '{"a": 1}', "slow": slow, "odd": odd}


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(f"t{i}", f"text {i}") for i in range(3)] + [(None, None)], "transaction_id string, raw_line_description string").coalesce(1)


@pytest.mark.parametrize(("make", "why"), [("broken", "call failed: away"), ("babbling", "unreadable answer"), ("no list", "unreadable answer: not a list"), ("slow", "no answer in time")])
def test_a_failure_is_a_row(rows, make, why):
    found = models.classify(rows, stand_ins()[make], attempts=2, seconds=0.3).collect()
    assert len(found) == 4 and all(r.confidence == 0 and r.method == "LLM" and r.internal_category_l1 is None and r.reasoning.startswith(why) for r in found)


def test_odd_answers(rows):
    found = {r.transaction_id: r for r in models.classify(rows, stand_ins()["odd"]).collect()}
    assert (found["t0"].internal_category_l1, found["t0"].confidence) == ("5", 0.0)
    assert (found["t1"].internal_category_l1, found["t1"].confidence) == ("IT", 0.70)
    assert found["t2"].reasoning == found[None].reasoning == "no answer for this row"


def test_batches_and_a_second_attempt():
    seen = []

    def ask(items):
        seen.append(len(items))
        if len(seen) == 1:
            raise OSError("not now")
        return json.dumps([i | {"x": 1} for i in items])

    items = [{"id": i} for i in range(5)]
    assert models._answers(ask, items, "id", 3, 5.0) == [{"id": i, "x": 1} for i in range(5)] and seen == [5, 5]


def test_rows_are_asked_in_batches(spark):
    def counting():
        return lambda items: json.dumps([{"k": i["k"], "n": len(items)} for i in items])

    df = spark.range(45).selectExpr("cast(id AS string) AS k").coalesce(1)
    assert sorted(r.n for r in models.ask_each(df, counting, "k", {"n": "double"}).collect()) == [5.0] * 5 + [20.0] * 40


def test_without_a_model(spark, rows):
    assert {(r.confidence, r.method) for r in models.classify(rows).collect()} == {(0.0, "DRY_RUN")}
    store = spark.createDataFrame([("a", [1.0])], "id string, vector array<float>")
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    found, same = models.encode(texts, store)
    assert [tuple(r) for r in found.collect()] == [("a", [1.0])] and same is store
    names = spark.createDataFrame([("a",), (None,)], "supplier_name string")
    assert [(r.supplier_name, r.parent_company_name, r.method) for r in models.parents(names).collect()] == [("a", None, "DRY_RUN")]
    recommendations = spark.createDataFrame([("TAIL", "x"), ("TAIL", None)], "type string, context string")
    assert [r.narrative for r in models.narratives(recommendations).collect()] == [None, None]


def test_only_new_texts_are_encoded(spark):
    store = spark.createDataFrame([("a", [1.0], "kept")], "id string, vector array<float>, note string")
    texts = spark.createDataFrame([("a",), ("bee",), ("bee",), (None,)], "text string")
    found, grown = models.encode(texts, store, hooks.measure)
    assert {r.text: r.vector for r in found.collect()} == {"a": [1.0], "bee": [3.0, 2.0, 0.0]}
    assert {(r.id, r.note) for r in grown.collect()} == {("a", "kept"), ("bee", None)}
    assert models.encode(texts, store, stand_ins()["broken"])[0].count() == 1


def test_narratives_by_type_and_context(spark):
    def writer():
        return lambda items: json.dumps([{"narrative_key": i["narrative_key"], "narrative": i["narrative_key"].lower()} for i in items])

    df = spark.createDataFrame([("TAIL", "x", 1), ("TAIL", "x", 2), ("ABC", None, 3)], "type string, context string, n int")
    assert {(r.n, r.narrative) for r in models.narratives(df, writer).collect()} == {(1, "tail|x"), (2, "tail|x"), (3, "abc|")}
