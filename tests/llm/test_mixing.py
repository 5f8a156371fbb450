"""Mixing against an iterative reference."""

import pytest
from outlay.llm import mixing


def reshared(sizes, cycle=(1, 2, 3), cap=3):
    """Targets by sharing again and again, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_weights = sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / open_weights for s in order}
        above = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("lengths", [{"a": 5, "b": 500, "c": 7, None: 90}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 2}, {"x": 10}, {"a": 0, "b": 40, "c": 3}])
def test_targets_and_copies(spark, lengths):
    rows, n = [], 0
    for source, words in lengths.items():
        for i in range(10):
            n += 1
            rows.append((n, " ".join(["w"] * (words + i % 2)), source))
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in lengths}
    want = reshared(sizes)
    got = mixing.mix(spark, documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len(r.row.text.split()) and r.source_size == sizes[r.row.source]
        assert r.target == pytest.approx(want[r.row.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert 0 <= r.copies <= 3 and abs(r.copies - rate) < 1 + 1e-9
    assert sum({r.row.source: r.target for r in got}.values()) == pytest.approx(sum(sizes.values()))


def test_taken_comes_near_its_target(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 11)), f"s{i % 4}" if i % 3 else "hot") for i in range(6000)]
    mixed = mixing.mix(spark, documents(spark, rows))
    taken, target = {}, {}
    for r in mixed.collect():
        taken[r.row.source] = taken.get(r.row.source, 0) + r["size"] * r.copies
        target[r.row.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.1)
    assert mixing.emit(mixed).count() == sum(r.copies for r in mixing.mix(spark, documents(spark, rows)).collect())


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    rows = [(1, None, None), (1, None, None), (2, "", "a"), (None, " \t ", "a"), (3, "one two", "a"), (3, "one two", "a")]
    docs = documents(spark, rows).selectExpr("*", "1 AS size", "2 AS copies", "3 AS copy_no", "4 AS mix_source", "5 AS target", "6 AS source_size", "7 AS row")
    got = mixing.mix(spark, docs).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 0, 2, 2]
    assert all(r.copies == 0 for r in got if r.row.source is None)
    assert {r.copies for r in got if r.row.doc_id == 3} == {1}
    kept = mixing.emit(mixing.mix(spark, docs))
    assert kept.columns == docs.columns
    assert {(r["size"], r.copies, r.copy_no, r.mix_source, r.target, r.source_size) for r in kept.collect()} == {(1, 2, 3, 4, 5, 6)}


def test_empty(spark):
    assert mixing.emit(mixing.mix(spark, documents(spark, []))).count() == 0
