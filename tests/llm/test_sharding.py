"""Sharding against exhaustive search."""

import random
from itertools import combinations
from zlib import crc32

import pytest
from outlay.llm import sharding as S


def best_capacity(sizes, shards):
    n = len(sizes)
    best = sum(sizes)
    for cuts in combinations(range(1, n), min(shards - 1, n - 1)):
        ends = [0, *cuts, n]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(ends, ends[1:], strict=False)))
    return best


def rows_of(rng, n):
    texts = ["x" * rng.choice([0, 3, 3, 50, 400]) + str(rng.randrange(n)) for _ in range(max(1, n // 2))]
    return [(i, rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("n,shards,cells", [(14, 4, 1 << 14), (14, 4, 8), (9, 16, 4), (1, 3, 4)])
def test_smallest_capacity(spark, monkeypatch, n, shards, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    monkeypatch.setattr(S, "FINER", 4)
    rows = rows_of(random.Random(n + shards), n)
    got = S.shard(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, [i, 0])[1] += len(t.encode()) + 1
    sizes = [s for _, s in sorted(groups.values())]
    loads = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
    assert sum(loads.values()) == sum(sizes) and max(loads.values()) == best_capacity(sizes, shards)


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert {(r.doc_id, r["size"]) for r in got} == {(i, len((t or "").encode()) + 1) for i, t in rows}
    slots = {}
    for r in got:
        assert 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_rows_with_a_hot_group(spark):
    rng = random.Random(7)
    rows = [(i, "the same text" if i % 3 == 0 else f"text {rng.randrange(10**6)} " * rng.randrange(1, 9)) for i in range(3000)]
    got = S.shard(spark, spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    check(rows, got, 16)
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) == 1
    texts = dict(rows)
    assert all(r.text_crc32 == crc32(texts[r.doc_id].encode()) for r in got)
    order = {}
    for i, t in rows:
        order.setdefault(t, i)
    shards = sorted((order[texts[r.doc_id]], r.shard) for r in got)
    assert [s for _, s in shards] == sorted(s for _, s in shards)
    again = S.shard(spark, spark.createDataFrame(rows[::-1], "doc_id long, text string"), 16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_nulls_repeats_long_and_clashing_columns(spark):
    rows = [(1, None), (1, None), (None, None), (2, ""), (3, "é" * 200_000), (3, "b"), (3, "b"), (None, "b"), (4, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS shard", "3 AS slot", "4 AS group_key", "5 AS start")
    got = S.shard(spark, docs, 3).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert len({r.shard for r in got if r.text_crc32 is None}) == 1


def test_empty(spark):
    assert S.shard(spark, spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
