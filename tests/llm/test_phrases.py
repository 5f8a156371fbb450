"""Collocations against counting every n-gram in Python, and against the SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from outlay.llm import oracles
from outlay.llm import phrases as X
from outlay.llm import queries as Q


def brute(rows, least=30, most=4, inside=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    dropped = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                p = (lang, words[i : i + k])
                if 100 * a >= inside * candidates[p]:
                    dropped.add(p)
    found = defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) in dropped:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {lang: [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])] for lang, rows in found.items()}


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = "alpha beta Gamma delta ÉTÉ x\x00y new york city of the in 日本 e-mail don't a b".split(" ")
    out = []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(0, 40))
        if rng.random() < 0.5:
            at = rng.randrange(len(words) + 1)
            words[at:at] = "New York City hall".split()[: rng.randrange(2, 5)]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?", "\x1c"]) for w in words)
        out.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return out


def result(spark, rows, **how):
    table = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS size", "2 AS phrase").repartition(6)
    got = defaultdict(list)
    for r in X.collocations(spark, table, **how).collect():
        got[r.lang].append(tuple(r))
    return {k: sorted(v, key=lambda t: t[1]) for k, v in got.items()}


def test_against_brute_force(spark):
    rows = texts(500, 1) + [(None, None), ("en", ""), ("en", None), ("fr", "only one"), ("long", "ping pong ding dong " * 20_000)] + [("hot", "the same line in all")] * 400
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, least=300, inside=50, top=3, most=3) == brute(rows, 300, 3, 50, 3)


def test_small_chunks(spark, monkeypatch):
    rows = [(lang or "und", text) for lang, text in texts(120, 2)]
    want = Counter()
    for lang, text in rows:
        for piece in re.split(b"[.,;:!?\n\x0b\x0c\r]", (text or "").encode()):
            words = re.sub(b"[A-Z]", lambda m: m[0].lower(), piece).replace(b"\t", b" ").split(b" ")
            words = [w for w in words if w]
            want.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    monkeypatch.setattr(X, "CHUNK", 50)
    monkeypatch.setattr(X, "HASHED", 7)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([(r[1] or "").encode() for r in rows])], ["lang", "text"])
    got = Counter()
    for names, words in X._chunks(iter([batch])):
        for size, at, _ in X.places(words, [], 3):
            got.update((names[words.lang[i]], tuple(words.word(j) for j in range(i, i + size))) for i in at.tolist())
    assert got == want


def test_words_with_one_hash_stay_apart():
    words = X.words_of([b"aa bb aa cc", b"aa"], [0, 1], np.array([1, 2], np.uint64))
    at = np.arange(5)
    plain = X.word_ids(words, at)
    words.hash[:] = 7
    forced = X.word_ids(words, at)
    for ids in (plain, forced):
        assert ids[0] == ids[2] and len(set(ids.tolist())) == 4


def test_sketch_loses_nothing(spark):
    rows = [("en", f"w{i} w{i + 1}") for i in range(3000)] + [("en", "often here")] * 30 + [("en", "not quite")] * 29
    table = spark.createDataFrame([(k, t.encode()) for k, t in rows], "lang string, text binary").repartition(7)
    s = X.sketch(spark, table, 0, 2, 30, 16, spark.sparkContext.broadcast([]))
    for text, least in (("often here", True), ("not quite", False)):
        words = X.words_of([text.encode()], [0], np.array([X.xxhash.xxh3_64_intdigest("en")], np.uint64))
        codes = [c for _, _, c in X.places(words, [], 2)][1]
        assert s.passes(codes).tolist() == [least]


def test_empty_table(spark):
    assert X.collocations(spark, spark.createDataFrame([], "lang string, text string")).count() == 0


def test_query_against_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet')")
    want = con.execute(oracles.oracle_sql()["op13_phrases"])
    columns = [d[0] for d in want.description]
    got = Q.queries()["op13_phrases"](spark, at).select(*columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())
