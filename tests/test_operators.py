"""Hand-made cases of operators that the whole-table queries don't reach."""

import datetime
import functools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlay import reference, schema
from outlay.functions import dates, fuzzy, text
from outlay.operators import categorise, changes, ingest, segments, similar, suppliers, vectors
from outlay.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "want"),
    [("15/03/2024", (2024, 3, 15)), ("2024-03-18", (2024, 3, 18)), ("20-Mar-2024", (2024, 3, 20)), ("5/4/2024", (2024, 4, 5)), ("March 15 2024", (2024, 3, 15)), ("45369", (2024, 3, 18)), ("", None), (None, None), ("soon", None)],
)
def test_dates(spark, value, want):
    assert one(spark, dates.parse_date(F.lit(value).cast("string"))) == (datetime.date(*want) if want else None)


@pytest.mark.parametrize(("value", "want"), [("acme p/l", "acme"), ("SODEXO AUSTRALIA", "sodexo australia"), ("Sodexo Aust P/L", "sodexo australia"), ("T/A Acme Pty Ltd", "acme"), ("  ", ""), (None, "")])
def test_normalised_names(spark, value, want):
    assert one(spark, text.normalise_name(F.lit(value).cast("string"))) == want


def test_terms_and_codes(spark):
    assert [one(spark, text.payment_terms_days(F.lit(x))) for x in ("Net 30", "NET30", "45 days", "EOM", "N/A")] == [30, 30, 45, None, None]
    assert [one(spark, text.gl_normalised(F.lit(x))) for x in ("06420", "000", "6420")] == ["6420", "0", "6420"]


def test_fuzzy_scores():
    assert fuzzy.composite("acme", "acme") == 1.0
    assert fuzzy.composite("sodexo australia", "australia sodexo") > 0.88
    assert fuzzy.composite("acme", "bolt") < 0.7


def test_ingest_lands_rows_once(spark, tmp_path):
    (tmp_path / "in.csv").write_text("VENDOR_NAME,INV_NO,INV_DATE,LINE_DESC,AMT,CCY,GL_CODE,PAY_TERMS\nAcme P/L,INV-1,15/03/2024,toner,100.50,USD,0642,Net 30\n,CN-2,2024-03-18,GST,-5,AUD,2100,N/A\n")
    raw = files.read_export(spark, str(tmp_path / "in.csv"))
    rates = spark.createDataFrame([("2024-03", "USD", "AUD", 1.5)], "year_month string, from_ccy string, to_ccy string, rate double")
    df = ingest.ingest(raw, rates, "E1")
    rows = {r.invoice_number: r for r in df.collect()}
    assert (rows["INV-1"].base_amount, rows["INV-1"].payment_terms_days, rows["INV-1"].document_type) == (150.75, 30, "INVOICE")
    assert (rows["CN-2"].raw_supplier_name, rows["CN-2"].is_tax_line, rows["CN-2"].is_credit_note) == (None, 1, 1)
    assert ingest.insert_counts(df, df).first().asDict() == {"new_rows": 0, "duplicate_rows": 2}
    with pytest.raises(ValueError, match="original_amount"):
        ingest.ingest(raw.drop("AMT"), rates, "E1")


def test_harmonise(spark):
    rows = [("Acme Pty Ltd", "V1"), ("ACME P/L", "V2"), ("Sodexo Austrlia", "V3"), ("Brand New", "V9"), ("Odd name", "V7"), (None, "V8")]
    df = spark.createDataFrame(rows, "raw_supplier_name string, raw_supplier_id string").withColumn("base_amount", F.lit(1.0))
    master = spark.createDataFrame([("s1", "Sodexo Australia", "sodexo australia", None, None, '{"raw_ids":["V7"]}')], schema.MASTER_SCHEMA)
    grown, log = suppliers.harmonise(df, master)
    got = {r.raw_supplier_name: r for r in log.collect()}
    assert got["Acme Pty Ltd"].match_method == got["ACME P/L"].match_method == "NORMALISED_NAME_GROUP"
    assert (got["Sodexo Austrlia"].canonical_supplier_id, got["Sodexo Austrlia"].match_method) == ("s1", "FUZZY_AUTO")
    assert (got["Odd name"].canonical_supplier_id, got["Odd name"].match_method) == ("s1", "EXACT_VENDOR_ID")
    assert got["Brand New"].match_method == "NEW_CANONICAL"
    attached = suppliers.attach_suppliers(df, log, grown)
    assert attached.count() == 6 and attached.where("canonical_supplier_id is null").count() == 1


def all_pairs(names, known):
    return {n: min((-fuzzy.composite(n, k), k, i) for k, i in known if k) for n in names if n is not None}


@pytest.mark.parametrize("cell", [1024, 3])
def test_fuzzy_match_is_that_of_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "BLOCK", 2)
    monkeypatch.setattr(similar, "POSTINGS", 2)
    names = ["b h p", "3 m", "h p", "qq", "", "sodexo austrlia", "acme acme", "a", "bank of new south wales", "müller", "x  y", "w" * 70, "acme steel works of the north and of the south and of all the rest of it", None]
    known = ["bhp", "3m", "hp", "sodexo australia", "acme", "acme steel", "acme steel works", "wales bank", "muller", "y x", "aa bb", "", "w" * 66, "north north", None]
    known = [(k, f"s{i}") for i, k in enumerate(known + ["bhp"])]
    left = spark.createDataFrame([(n,) for n in names + ["b h p"]], "normalised_name string")
    master = spark.createDataFrame(known, "normalised_name string, canonical_supplier_id string")
    want = all_pairs(names, known)
    got = {r.normalised_name: r for r in suppliers.match_fuzzy(left, master).collect()}
    assert {n: (r.fuzzy_score, r.fuzzy_id) for n, r in got.items()} == {n: (-score, i) for n, (score, _, i) in want.items()}
    assert [got[n].fuzzy.method for n in ("b h p", "3 m", "h p", "qq")] == ["FUZZY_REVIEW"] * 3 + ["FUZZY_REJECT"]
    sure = suppliers.match_fuzzy(left, master, rejected=False)
    assert {r.normalised_name: r.fuzzy_score for r in sure.collect()} == {n: -s for n, (s, *_) in want.items() if -s >= 0.7}
    assert suppliers.match_fuzzy(left, master.limit(0)).count() == suppliers.match_fuzzy(left.limit(0), master).count() == 0


def invented_names(rng, n):
    words = "australia services group steel water power bank north south trading supply tech medical clean office paper fuel auto".split()
    return [" ".join(rng.sample(words, rng.randrange(1, 3)) + ["".join(rng.choices("bcdfghjklmnprstvaeiou", k=rng.randrange(3, 10)))]) for _ in range(n)]


def test_fuzzy_join_compares_few_pairs(spark, monkeypatch):
    """Equal to all pairs, though few of them reach the exact comparison; no plan pairs every name with every supplier."""
    monkeypatch.setattr(similar, "CELL", 50)
    rng = random.Random(9)
    known = invented_names(rng, 700)
    names = invented_names(rng, 150) + [k[:-1] + "x" for k in known[:100]] + ["".join(k.split()) for k in known[100:150]]
    left = spark.createDataFrame([(n,) for n in names], "name string")
    table = spark.createDataFrame([(k, f"s{i}") for i, k in enumerate(known)], "candidate string, canonical_supplier_id string")
    cells = similar.cells_of(table)
    assert len(cells.sizes) > 8 and cells.sizes.sum() == len(known)
    found = similar.by_letters(left, table, cells, 0.7).unionByName(similar.by_words(left, table, 0.7))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = {n: s for n in names for s in [max(fuzzy.composite(n, k) for k in known)] if s >= 0.7}
    got = {}
    for r in found.collect():
        got[r.name] = max(got.get(r.name, 0), r.score)
    assert got == want
    compared, stretches = [0], fuzzy._stretches
    monkeypatch.setattr(fuzzy, "_stretches", lambda block, masks, size, at: compared.__setitem__(0, compared[0] + len(at)) or stretches(block, masks, size, at))
    fuzzy.best_of(names, known, 0.7)
    assert compared[0] < 0.05 * len(names) * len(known)


def test_best_of_a_block_is_that_of_all():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcü", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["", " ", "ab ab  ab", "ab " * 30, "a" * 64, "ü" * 65]
    for floor in (0.0, 0.7):
        for a, got in zip(texts, fuzzy.best_of(texts, texts, floor), strict=True):
            every = [fuzzy.composite(a, b) for b in texts]
            assert got == ((max(every), every.index(max(every))) if max(every) >= floor else (-1.0, -1))


def test_cells_lose_nothing():
    rng = random.Random(6)
    known = invented_names(rng, 400)
    measures, repeats = similar._measures(known)
    tree = similar._borders(measures, 16)
    cells = similar.Cells(tree, np.zeros((16, 65), np.int64), np.zeros((16, 65), np.int64), np.zeros(16, bool), np.zeros(16, np.int64))
    place = cells.place(measures)
    for c in range(16):
        own = np.flatnonzero(place == c)
        cells.low[c], cells.high[c], cells.sizes[c] = measures[own].min(axis=0), measures[own].max(axis=0), len(own)
    for name in invented_names(rng, 60):
        for ratio in (0.4, 0.625, 0.8):
            near = {int(place[j]) for j, k in enumerate(known) if fuzzy.sorted_ratio(name, k) >= 100 * ratio}
            assert near <= set(cells.within_reach(name, ratio))


def brute_cosine(queries, candidates, top):
    def dot(a, b):  # from the first on, unlike sum(), which makes up for rounding
        return functools.reduce(lambda s, xy: s + xy[0] * xy[1], zip(a, b, strict=True), 0.0)

    def cosine(a, b):
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)) + 1e-10)

    return {(q, i + 1, c, s) for q, v in queries for i, (s, c) in enumerate([(-s, c) for s, c in sorted((-cosine(v, w), c) for c, w in candidates)][:top])}


@pytest.mark.parametrize("small", [True, False])
def test_vectors_match_as_all_pairs_do(spark, monkeypatch, small):
    monkeypatch.setattr(vectors, "is_small", lambda df: small)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERIES", 5)
    rng = random.Random(8)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    some = lambda n: [[x + rng.gauss(0, 0.2) for x in centre[i % 5]] for i in range(n)]
    candidates = list(enumerate(some(80)))
    candidates += [(100 + i, v) for i, v in candidates[:20]] + [(200, [0.0] * 6)]  # ties, and one without a direction
    queries = list(enumerate(some(40))) + [(90, [0.0] * 6), (91, candidates[3][1])]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [1.0])]
    a = spark.createDataFrame(queries + odd, "id long, vector array<double>").repartition(4)
    b = spark.createDataFrame(candidates + odd, "id long, vector array<double>").repartition(3)
    for top in (1, 2, 30, 500):
        out = vectors.match_vectors(a, b, top)
        assert {(r.query_id, r["rank"], r.candidate_id, r.similarity) for r in out.collect()} == brute_cosine(queries, candidates, top)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and (top > 100 or "WindowGroupLimit" in plan)
    assert vectors.match_vectors(a, b.limit(0)).count() == vectors.match_vectors(a.limit(0), b).count() == 0


def test_cells_of_vectors_spare_comparisons():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    known = np.concatenate([c + rng.normal(scale=0.05, size=(50, 16)) for c in centres])
    cells = vectors.Cells(known[::50])
    place, angle = cells.place(known)
    for c in range(20):
        cells.radius[c], cells.sizes[c] = angle[place == c].max(initial=0), (place == c).sum()
    asked = known[::7] + rng.normal(scale=0.01, size=(143, 16))
    best = vectors.nearest(asked, known, 1)[2]
    assert sum(map(len, cells.within_reach(asked, best))) < 0.2 * len(asked) * 20


def test_harmonise_finds_initials(spark):
    df = spark.createDataFrame([("B.H.P.", "V1"), ("Zyx", "V2")], "raw_supplier_name string, raw_supplier_id string")
    master = spark.createDataFrame([("s1", "BHP", "bhp", None, None, '{"raw_ids":[]}')], schema.MASTER_SCHEMA)
    got = {r.raw_supplier_name: (r.canonical_supplier_id, r.match_method) for r in suppliers.harmonise(df, master)[1].collect()}
    assert got["B.H.P."] == ("s1", "FUZZY_REVIEW") and got["Zyx"][1] == "NEW_CANONICAL"


def test_changes(spark):
    df = spark.createDataFrame([("t1", "a", None, None, None, None, None, None), ("t2", "b", "Old", None, None, None, 0.4, "KEYWORD")], "transaction_id string, raw_supplier_name string, category_l1 string, category_l2 string, category_l3 string, unspsc_code string, category_confidence double, category_method string")
    found = df.limit(0).unionByName(spark.createDataFrame([("t2", "b", "New", None, None, None, 1.0, "MANUAL")], df.schema))
    assert {r.transaction_id: r.category_l1 for r in changes.set_categories(df, found).collect()} == {"t1": None, "t2": "New"}
    log = spark.createDataFrame([("a", "V", "s1", "FUZZY_REVIEW", 0.5, "", "PENDING")], schema.MATCH_LOG_SCHEMA)
    assert changes.decide(log, "a", "APPROVED").first().review_status == "APPROVED"
    store = spark.createDataFrame([("x", [1.0])], "id string, vector array<double>")
    assert changes.insert_vectors(store, spark.createDataFrame([("x", [2.0]), ("y", [3.0])], store.schema)).count() == 2
    assert changes.audit(spark.createDataFrame([], schema.AUDIT_SCHEMA), "match", "a", "approve", None, "APPROVED", "me").count() == 1


def test_tail_of_few_and_many(spark):
    rows = spark.createDataFrame([(f"s{i:02d}", 10_000.0 * (12 - i), 0, 0) for i in range(12)], "canonical_supplier_id string, base_amount double, is_intercompany int, is_tax_line int")
    assert {r.canonical_supplier_id for r in segments.tail(rows).where("is_tail_spend").collect()} == {f"s{i:02d}" for i in range(7, 12)}
    few = rows.where("canonical_supplier_id < 's03'")
    assert [r.canonical_supplier_id for r in segments.tail(few).where("is_tail_spend").collect()] == ["s02"]
    assert segments.tail(rows.limit(0)).count() == 0


def test_keyword_ties_and_nothing(spark):
    df = spark.createDataFrame([("toner for a printer",), ("xyzzy",), (None,)], "raw_line_description string")
    got = [r.by_keyword and r.by_keyword.l2 for r in categorise.by_keyword(df).collect()]
    assert got == ["Print Consumables", None, None]


def test_keywords_are_those_of_the_patterns(spark):
    """Each rule's result is that of a search for its pattern, letter for letter."""
    import re

    rng = random.Random(4)
    words = sorted({w for pattern, *_ in reference.KEYWORD_RULES for w in pattern.split("|")}) + ["third-party logistics", "third party", "pickxandxpack", "fit out", "san", "fuels", "L&D"]
    texts = words + [" ".join(rng.choices(words, k=3)) for _ in range(300)] + [w[:-1] for w in words] + ["", " "]
    df = spark.createDataFrame([(t.upper() if i % 3 else t,) for i, t in enumerate(texts)], "raw_line_description string")
    ordered = sorted(reference.KEYWORD_RULES, key=lambda r: -r[4])
    want = lambda t: next(((l1, l2, unspsc, c) for pattern, l1, l2, unspsc, c in ordered if re.search(pattern, t.lower())), None)
    for r in categorise.by_keyword(df).collect():
        k = r.by_keyword
        assert (k and (k.l1, k.l2, k.unspsc, k.confidence)) == want(r.raw_line_description)
    plan = categorise.by_keyword(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 6


def test_views_round_trip(spark, tmp_path):
    view = spark.createDataFrame([("a", 1.5)], "name string, total double").withColumn("money", F.lit("2.50").cast("decimal(18,2)"))
    files.write_views({"v": view}, str(tmp_path))
    assert files.read_views(spark, str(tmp_path), "v")["v"].first().asDict() == {"name": "a", "total": 1.5, "money": 2.5}
    assert files.config_from("[1]") == {} and files.config_from('{"wacc": 0.1}') == {"wacc": 0.1}


def test_partial_ratio_is_that_of_all_stretches():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc xyz", k=rng.randrange(0, 12))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        every = [fuzzy.ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))] if short else [0.0 if long else 100.0]
        assert fuzzy.partial_ratio(a, b) == max(every)


def test_boosts_lift_a_pair_over_a_threshold(spark):
    names = spark.createDataFrame([("acmee steel",), ("other",)], "normalised_name string")
    master = spark.createDataFrame([("acme works", "s1"), ("zzz", "s2")], "normalised_name string, canonical_supplier_id string")
    plain = {r.normalised_name: r for r in suppliers.match_fuzzy(names, master).collect()}
    points = spark.createDataFrame([("acmee steel", "s1", 40), ("other", "s9", 90)], "normalised_name string, canonical_supplier_id string, boost int")
    lifted = {r.normalised_name: r for r in suppliers.match_fuzzy(names, master, boosts=points).collect()}
    assert plain["acmee steel"].fuzzy.method == "FUZZY_REJECT" and lifted["acmee steel"].fuzzy.method != "FUZZY_REJECT"
    assert lifted["acmee steel"].fuzzy_score == plain["acmee steel"].fuzzy_score and lifted["other"].fuzzy.method == "FUZZY_REJECT"


def test_names_that_are_all_alike_meet_few_suppliers(spark, monkeypatch):
    """Numbered names share a word and nearly all letters; few pairs have their words compared, and the best are those of all pairs."""
    rng = random.Random(12)
    numbers = rng.sample(range(3000), 500)
    names, known = [[f"supplier {n:09d}" for n in part] for part in (numbers[:100], numbers[100:])]
    calls, whole = [0], fuzzy.set_ratio
    monkeypatch.setattr(fuzzy, "set_ratio", lambda a, b: calls.__setitem__(0, calls[0] + 1) or whole(a, b))
    fuzzy.best_of(names, known, 0.7)
    assert calls[0] < 0.1 * len(names) * len(known)
    monkeypatch.undo()
    left = spark.createDataFrame([(n,) for n in names[:40]], "normalised_name string")
    master = spark.createDataFrame([(f"s{i}", k) for i, k in enumerate(known)], "canonical_supplier_id string, normalised_name string")
    got = {r.normalised_name: (r.fuzzy_score, r.fuzzy_id) for r in suppliers.match_fuzzy(left, master, rejected=False).collect()}
    want = {n: min((-fuzzy.composite(n, k), k, f"s{i}") for i, k in enumerate(known)) for n in names[:40]}
    assert got == {n: (-score, i) for n, (score, _, i) in want.items()}
