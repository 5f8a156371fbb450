"""Near-duplicates against brute force, and the parts that must lose nothing."""

import random
from itertools import combinations

import numpy as np
import pytest
from outlay.llm import near_dedup as N
from outlay.llm.common import WordHashes, shingle_set, words_of


def brute(rows, size, part, whole):
    """doc_id -> (set size, component), by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = words_of((text or "").encode())
        k = min(size, len(w))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                both = len(x & y)
                if both and whole * both >= part * (len(x) + len(y) - both):
                    ra, rb = sorted((root(a), root(b)))
                    parent[rb] = ra
    return {i: ([len(s) for s in sets[i]], root(i)) for i in sets}


def family(rng, base, n, rate):
    """Copies of a text with some words changed."""
    return [" ".join(rng.choice("abcdefghij") * 3 if rng.random() < rate else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("size,part", [(3, 85), (5, 80)])
def test_against_brute_force(spark, size, part):
    rng = random.Random(size)
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 60, 150]))]
        texts += [" ".join(base)] * rng.choice([1, 3]) + family(rng, base, 12, rng.choice([0.01, 0.02, 0.04]))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    texts += ["", None, " \t ", "one", "One", "one two", "one  two", "two one"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows, size, part, 100)
    got = N.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, part=part).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == want[r.doc_id][0][0]
        assert r.component_id == want[r.doc_id][1]
        assert r.kept == (r.doc_id == r.component_id)


def test_a_large_group_around_the_threshold(spark):
    """Many near copies of which many are linked with few or none: blocks find every link that matters."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = family(rng, base, 400, 0.03)
    rows = list(enumerate(texts))
    want = brute(rows, 3, 85, 100)
    got = N.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, part=85).collect()
    assert len({want[i][1] for i, _ in rows}) > 20
    assert {r.doc_id: r.component_id for r in got} == {i: want[i][1] for i, _ in rows}


def test_blocks_in_many_units(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "PROBES", 11)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, [f"w{i}" for i in range(100)], 90, 0.03)))
    want = brute(rows, 3, 85, 100)
    got = N.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, part=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: want[i][1] for i, _ in rows}


def test_repeated_ids_nulls_and_clashing_columns(spark):
    a, b, c = "a b c d e f g h i j", "k l m n o p q r s t", "x y z x y z x y z w"
    rows = [(5, a), (5, a), (5, b), (3, b), (9, a), (None, a), (None, None), (8, c), (7, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS component_id", "3 AS kept", "4 AS class", "'q' AS bucket")
    got = N.near_duplicates(spark, docs, shingle=3, part=85).collect()
    assert len(got) == len(rows)
    components = {r.doc_id: r.component_id for r in got}
    # id 5 stands with both texts and links them
    assert components == {5: 3, 3: 3, 9: 3, None: None, 8: 8, 7: 7, 6: 6}
    assert all(r.kept for r in got if r.doc_id is None)
    kept = N.keep_first(spark, docs, shingle=3, part=85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 6, 7, 8]
    assert kept.where("doc_id is null").count() == 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(spark, docs).count() == 0
    assert N.keep_first(spark, docs).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
    rows = [(1, text), (2, text + " end"), (3, "w1 w2 w3 w4 w5 w6")]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (7, 7), (9, 160)]
    got = {r.node: r.component for r in N.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {9} and got[9] == 9 and {got[i] for i in (1, 2, 3)} == {1} and 7 not in got


def test_pruning_misses_as_rarely_as_chosen():
    least = N.least_matches(0.85, 1e-6)
    assert [n for n, _ in least] == list(range(20, 121, 20))
    rng = np.random.default_rng(1)
    same = rng.random((20_000, N.SIZE)) < 0.85
    assert N.plausible(same.astype(np.uint32), np.ones_like(same, np.uint32), least).all()
    assert not N.plausible((rng.random((2000, N.SIZE)) < 0.4).astype(np.uint32), np.ones((2000, N.SIZE), np.uint32), least).any()


def test_signatures_estimate_similarity():
    hashes = WordHashes()
    a = shingle_set([b"%d" % i for i in range(1000)], 3, hashes)
    b = shingle_set([b"%d" % i for i in range(500, 1500)], 3, hashes)
    assert abs((N.signature(a) == N.signature(b)).mean() - 1 / 3) < 0.15
