"""License scan against exact containment of every window."""

import random

from outlay.llm import licenses as L


def brute(text, templates, least=0.8):
    w = L._plain_words(text)
    shingles = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for name, t in templates.items():
        tw = L._plain_words(t)
        wanted = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
        for at in range(0, max(0, len(w) - 4), 8):
            if not any(s in wanted for s in shingles[at : at + 12]):
                continue
            low, high = max(0, at - len(tw)), at + 16 + len(tw)
            inside = [i for i in range(low, min(len(shingles), high - 4)) if shingles[i] in wanted]
            share = len({shingles[i] for i in inside}) / len(wanted)
            if share >= least and share > out.get(name, (0,))[0]:
                out[name] = (share, inside[0], inside[-1] + 5)
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    filler = "lorem ipsum dolor sit amet license the of software free copy".split()
    rows = []
    for i in range(150):
        words = rng.choices(filler, k=rng.randrange(60))
        if i % 4:
            part = rng.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = rng.choice(filler)
            if i % 7 == 0:
                part = part[: len(part) * 9 // 10]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    got = {}
    for r in L.scan(spark, spark.createDataFrame(rows, "doc_id long, text string"), L.TEMPLATES).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.containment, r.first_word, r.end_word)
    assert got == {i: b for i, t in rows if (b := brute(t, L.TEMPLATES))}


def test_every_template_is_found_alone(spark):
    rows = list(enumerate(L.TEMPLATES.values()))
    got = {(r.doc_id, r.license) for r in L.scan(spark, spark.createDataFrame(rows, "doc_id long, text string"), L.TEMPLATES).collect() if r.containment == 1}
    assert set(enumerate(L.TEMPLATES)) <= got


def test_anchors_meet_every_shingle():
    seek = set(L.anchors(L.TEMPLATES))
    for t in L.TEMPLATES.values():
        w = L._plain_words(t)
        assert all(seek & set(w[i : i + 5]) for i in range(len(w) - 4))


def test_odd_rows(spark):
    mit = L.TEMPLATES["MIT"]
    rows = [(None, mit), (1, None), (2, ""), (3, "license"), (4, mit), (4, mit), (5, "word " * 100_000 + mit + " word" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS license", "3 AS at", "4 AS near", "5 AS row")
    got = sorted(((r.doc_id, r.license, r.first_word) for r in L.scan(spark, docs).collect()), key=str)
    assert got == [(4, "MIT", 0), (5, "MIT", 100_000), (None, "MIT", 0)]
    assert L.scan(spark, docs.limit(0)).count() == 0
    assert L.scan(spark, docs, templates={}).count() == 0


def told_apart(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: set() for i in range(len(texts))}
    for r in L.scan(spark, docs).collect():
        got[r.doc_id].add(r.license)
    return [got[i] for i in range(len(texts))]


def test_siblings_are_told_apart(spark):
    two, three = L.TEMPLATES["GPL-2.0"], L.TEMPLATES["GPL-3.0"]
    bsd2, bsd3 = L.SIBLINGS["BSD-2-Clause"], L.SIBLINGS["BSD-3-Clause"]
    filler = " other words" * 100
    texts = [two, three, f"{two} {three}", three + filler + two, bsd2, bsd3.replace("the copyright holder", "Foo Bar Inc"), bsd3 + filler + bsd2, bsd2 + filler + bsd3]
    both = {"BSD-2-Clause", "BSD-3-Clause"}
    assert told_apart(spark, texts) == [{"GPL-2.0"}, {"GPL-3.0"}, {"GPL-2.0", "GPL-3.0"}, {"GPL-2.0", "GPL-3.0"}, {"BSD-2-Clause"}, {"BSD-3-Clause"}, both, both]


def test_headers_of_other_versions_and_licenses(spark):
    names = [k for k in L.TEMPLATES | L.SIBLINGS if k.endswith("header")]
    got = told_apart(spark, [f"x y {(L.TEMPLATES | L.SIBLINGS)[k]} z" for k in names])
    assert [{x.split()[0] for x in g} for g in got] == [{k.split()[0]} for k in names]
    # a license that isn't in the list is not reported as one that is
    other = L.TEMPLATES["Apache-2.0 header"].replace("Apache License, Version 2.0", "Educational Community License, Version 2.0")
    assert told_apart(spark, [other, L.TEMPLATES["GPL-3.0"].replace("version 3", "version 1")]) == [set(), set()]


def test_an_index_that_is_too_large_to_broadcast(spark, monkeypatch):
    rows = [(i, f"some words {t} and more") for i, t in enumerate(L.ALL.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, L.scan(spark, docs).collect()))
    monkeypatch.setattr(L, "MOST_BANDS", 0)
    assert want and sorted(map(tuple, L.scan(spark, docs).collect())) == want


def test_query_and_sql_report_licenses_that_are_there(spark):
    import duckdb
    from outlay.llm import oracles
    from outlay.llm import queries as Q

    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet')")
    want = con.execute(oracles.oracle_sql()["op8_licenses"])
    columns = [d[0] for d in want.description]
    got = sorted(map(tuple, Q.queries()["op8_licenses"](spark, at).select(*columns).collect()))
    assert got and got == sorted(want.fetchall())
    # a line of version 3 is none of version 2
    lines = {r.doc_id for r in spark.read.parquet(f"{at}/documents.parquet").where("text LIKE '%General Public License, version 2%'").collect()}
    assert {g[columns.index("doc_id")] for g in got if g[columns.index("license")] == "GPL-2.0"} == lines
