"""Top-k against all pairs, and pruning where the data allow it."""

import numpy as np
from outlay.llm import topk as K
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, step, k):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            seen[i, tuple(v)] = np.floor(np.float32(v).astype(float) * 256) if len(v) else np.zeros(0)
    out = {}
    for (q, _), a in seen.items():
        if q % step == 0:
            scores = [(-int(np.dot(a[: min(len(a), len(b))], b[: min(len(a), len(b))])), i) for (i, _), b in seen.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def run(spark, rows, step, k=5, **how):
    got = {}
    for r in K.top_k(spark, spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % step == 0, k, **how).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [v[i + 1] for i in range(len(v))] for q, v in got.items()}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:400] = x[100]  # one very common vector
    x[500:600] = np.round(x[500:600])  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 7, 5)
    assert run(spark, rows, 7) == want
    assert run(spark, rows, 7, block=100, query_block=30) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0]), (6, []), (7, [0.5, -1.0]), (7, [0.5, -1.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0])]
    assert run(spark, rows, 5) == brute(rows, 5, 5)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS vector", "3 AS score", "4 AS b")
    assert K.top_k(spark, docs, F.col("vec_id") % 5 == 0).count() == sum(map(len, brute(rows, 5, 5).values()))
    assert K.top_k(spark, docs.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert run(spark, [(0, [1.0])], 5) == {}


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.floor((centres[:, None] + rng.normal(size=(40, 200, 16)) * 5).reshape(-1, 16))
    ids = np.arange(len(x))
    search = K.Search(x[::50], ids[::50], x, ids, 5)
    search.run()
    assert search.compared < 0.5 * len(x[::50]) * len(x)
    scores = x[::50] @ x.T
    scores[np.arange(len(scores)), ids[::50]] = -np.inf
    assert (search.scores == -np.sort(-scores, axis=1)[:, :5]).all()


def test_tree_covers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4))

    def walk(node):
        assert np.linalg.norm(x[node.points] - node.centre, axis=1).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            for c in node.children:
                walk(c)
        else:
            assert len(node.points) <= K.LEAF or node.radius == 0

    walk(K.cover_tree(x))


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for shift in (0, 3):
        x, y = rng.normal(size=(300, 6)) + shift, rng.normal(size=(300, 6)) * rng.choice([0, 1, 4], size=(300, 1))
        q, r = K._flat(K.cover_tree(x, leaf=4))[0], K._flat(K.cover_tree(y, leaf=4))[0]
        most = np.array([[(x[a.points] @ y[b.points].T).max() for b in r] for a in q])
        assert (most <= K.bounds(K.Shapes.of(q, x), K.Shapes.of(r, y))).all()


def test_clusters_are_pruned_before_rows_are_sent(spark, monkeypatch):
    """Rows sent to other cells grow with the rows, not with rows times queries."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    sent = []
    for n in (40, 160):
        x = (centres[:, None] + rng.normal(size=(40, n, 16)) * 0.05).reshape(-1, 16).astype(np.float32)
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        written = {}
        monkeypatch.setattr(K, "stored", lambda s, df, name, narrow=False, w=written, f=K.stored.__wrapped__ if hasattr(K.stored, "__wrapped__") else K.stored: w.setdefault(name, f(s, df, name, narrow)))
        assert run(spark, rows, 50, block=n) == brute(rows, 50, 5)
        sent.append(written["sent"].count())
        monkeypatch.undo()
    assert sent[0] < 0.3 * (40 * 40 // 50) * 40 and sent[1] < 8 * sent[0] + 100
