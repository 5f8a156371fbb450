"""How often plans read the transactions, and that look-ups don't move them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlay import reference, schema
from outlay.functions import dates, fuzzy, text
from outlay.operators import categorise, changes, cube, ingest, joins, kpis, quality, quantiles, recommend, runs, segments, similar, suppliers
from outlay.plans import insight, resolve
from outlay.sources import scratch
from outlay.sources.warehouse import transactions

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """The plans of all intermediate tables that are written from now on."""
    seen = []
    write = scratch.stored

    def noted(df, name, narrow=False):
        seen.append(plan_of(df))
        return write(df, name, narrow)

    for module in (scratch, recommend, kpis, runs):
        monkeypatch.setattr(module, "stored", noted)
    return seen


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(plans):
    return sum(line.count("l_extendedprice#") > 0 and "Relation" in line for plan in plans for line in plan.splitlines())


def test_savings_read_the_transactions_once(spark, plans):
    allocated = recommend.allocate(recommend.generate(transactions(spark, SF_DIR)))
    assert scans([*plans, plan_of(allocated)]) == 1


def test_key_figures_read_the_transactions_three_times(spark, plans):
    assert scans([plan_of(kpis.kpis(transactions(spark, SF_DIR))), *plans]) <= 3


def test_evaluation_reads_the_transactions_twice(spark, plans):
    df = transactions(spark, SF_DIR)
    cells = recommend.stored(recommend.cells(df), "cells")
    out = runs.evaluate(df, recommend.portfolio(recommend.allocate(recommend.generate(cells)), cells))
    assert scans([*plans, plan_of(out)]) <= 2


def test_look_ups_leave_the_transactions_where_they_are(spark):
    df = transactions(spark, SF_DIR, "transaction_id", "canonical_supplier_id", "canonical_supplier_name", "gl_account", "raw_line_description")
    out = categorise.categorise(df, resolve._seeds(spark), resolve._overrides(spark))
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and "ShuffledHashJoin" not in physical


def test_a_large_look_up_table_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)], "k string, v int")
    table = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "q")], "k string, r string")
    small, large = ({(r.v, r.r) for r in joins.look_up(df, table, "k", most).collect()} for most in (1 << 20, 0))
    assert small == large == {(1, "x"), (2, "y"), (3, None), (4, None)}


def test_the_cube_is_one_pass(spark, plans, monkeypatch):
    """All views and the suppliers' sums come from one pass; a whole run, with key figures, checks and the rows themselves, takes eight."""
    noted = runs.stored
    for module in (cube, quality, segments, quantiles):
        monkeypatch.setattr(module, "stored", noted, raising=False)
    df = transactions(spark, SF_DIR)
    views = cube.cube(df, "supplier_spend")
    assert set(views) == {*cube.VIEWS, "supplier_spend", "transactions"}
    assert scans([*plans, *[plan_of(v) for k, v in views.items() if k != "transactions"]]) == 1
    for name, keys in cube.VIEWS.items():
        want = cube.view(cube._timed(df), *keys)
        assert sorted(map(repr, views[name].collect())) == sorted(map(repr, want.select(*views[name].columns).collect()))
    plans.clear()
    frames = cube.summary(df)
    assert scans([*plans, *map(plan_of, frames.values())]) == 1
    plans.clear()
    tables = runs.build(df)
    assert scans([*plans, *map(plan_of, tables.values())]) <= 8


def test_quantiles_are_those_of_all_values(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, 5.0, -2.5, round(rng.uniform(-1e6, 1e6), 2), rng.random()])) for k in "abc" for _ in range(rng.randrange(1, 300))]
    rows += [("one", 7.0), ("two", 1.0), ("two", 2.0), ("same", 3.3), ("same", 3.3), ("same", 3.3), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(5)
    at = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    got = {r.key: (r.least, r.most, r.rows, *[getattr(r, q) for q in at]) for r in quantiles.exact(df, "key", F.col("value"), at).collect()}
    assert set(got) == {k for k, v in rows if k and v is not None}
    for k, found in got.items():
        own = [v for key, v in rows if key == k and v is not None]
        want = [min(own), max(own), len(own), *np.quantile(own, list(at.values()))]
        assert np.allclose(found, want, rtol=1e-12, atol=1e-9)
    # the second pass keeps few rows
    assert quantiles.exact(df.limit(0), "key", F.col("value"), at).count() == 0


@pytest.fixture
def shuffled(spark, monkeypatch):
    """No table is small, and tasks stay as they were planned."""
    monkeypatch.setattr(joins, "is_small", lambda table, most_bytes: False)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_common_supplier_is_dealt_over_all_tasks(spark, shuffled):
    """Nine of ten rows are one supplier's, and some have none: no task gets more than twice what the middle one does."""
    i = F.col("id")
    supplier = F.when(i % 10 > 0, F.lit("one")).when(i % 100 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (i % 500).cast("string")))
    df = spark.range(20_000).select(supplier.alias("canonical_supplier_id"), F.lit("E1").alias("engagement_id"), i.alias("n"))
    segments = df.where("canonical_supplier_id is not null").select("engagement_id", "canonical_supplier_id").distinct().withColumn("abc_segment", F.substring("canonical_supplier_id", 1, 2))
    out = changes.set_segments(df, segments)
    tasks = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect())
    assert len(tasks) == 16 and tasks[-1] <= 2 * tasks[8]
    assert out.count() == 20_000 and out.where("abc_segment = 'on'").count() == 18_000 and out.where("abc_segment is null").count() == 200
    assert out.where("abc_segment <> substring(canonical_supplier_id, 1, 2)").count() == 0


def test_dealing_out_keeps_every_row_of_several_keys(spark, shuffled):
    rows = [("E1", "a")] * 30 + [("E1", None)] * 5 + [(None, "a")] * 5 + [("E2", "a")] * 3 + [("E2", "z")]
    df = spark.createDataFrame([(*r, n, {"k": n}) for n, r in enumerate(rows)], "t string, s string, _salt int, m map<string,int>")
    table = spark.createDataFrame([("E1", "a", 1), ("E2", "a", 2)], "t string, s string, v int")
    got = sorted((r["_salt"], r.v or 0) for r in joins.look_up(df, table, ["t", "s"]).collect())
    assert got == [(n, {("E1", "a"): 1, ("E2", "a"): 2}.get(r, 0)) for n, r in enumerate(rows)]


def test_no_rows_and_no_seeds(spark):
    df = transactions(spark, SF_DIR, "transaction_id", "canonical_supplier_id", "canonical_supplier_name", "gl_account", "raw_line_description").where(F.lit(False))
    none = categorise.categorise(df, spark.createDataFrame([], reference.SEED_SCHEMA), spark.createDataFrame([], schema.OVERRIDE_SCHEMA))
    assert none.count() == 0


def test_names_are_normalised_once_a_name(spark):
    rows = spark.range(200).selectExpr("concat('Acme ', id % 3, case when id % 2 = 0 then ' Pty Ltd' else '' end) AS raw_supplier_name", "concat('V', id % 7) AS raw_supplier_id")
    master = suppliers.build_master(suppliers.distinct_names(rows))
    # a condition on the normalised name doesn't come down to the rows
    assert "Range (" not in master._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.normalised_name for r in master.collect()) == ["acme 0", "acme 1", "acme 2"]
    assert suppliers.vendor_ids(master).count() == 1


def test_no_pass_over_the_rows_sorts_texts(spark, plans):
    df = transactions(spark, SF_DIR)
    for out in (recommend.cells(df), quality._names(df, False), quality._names(df, True)):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_row_is_worked_out_by_short_programs(spark):
    df = transactions(spark, SF_DIR, "transaction_id", "canonical_supplier_id", "canonical_supplier_name", "gl_account", "raw_line_description", "raw_supplier_name", "invoice_number")
    # a loop over the words and one over the columns, not a step for each of them
    assert plan_of(categorise.by_keyword(df)).lower().count("contains(") <= 2
    cleaned = plan_of(ingest.clean(df)).lower()
    assert cleaned.count("contains(") <= 3 and cleaned.count("regexp_replace(") <= 3


def test_checks_read_the_transactions_twice(spark):
    df = transactions(spark, SF_DIR)
    assert all(scans([plan_of(quality.diagnose(df, by_words))]) == 2 for by_words in (True, False))


def test_orders_come_before_the_texts_of_suppliers_and_parts(spark):
    """So that a shuffle by order, where there is one, is without those texts."""
    plan = plan_of(transactions(spark, SF_DIR, "canonical_supplier_name", "category_l1", "business_unit")).splitlines()
    depth = {c: next(len(line) - len(line.lstrip(" :+-")) for line in plan if "Relation" in line and f"{c}#" in line) for c in ("o_orderkey", "s_suppkey", "p_partkey")}
    assert depth["o_orderkey"] > max(depth["s_suppkey"], depth["p_partkey"])


def test_savings_read_no_orders(spark, plans):
    df = transactions(spark, SF_DIR, *insight._EVERY)
    assert sorted(recommend.cells(df).columns) == sorted(recommend.cells(transactions(spark, SF_DIR)).columns)
    assert "o_orderkey" not in plan_of(recommend.cells(df))


def test_rates_are_joined_where_the_rows_are(spark):
    """The rows are read once and not shuffled; rates are the nearest known ones, whatever the month."""
    rates = [("1995-01", "USD", "AUD", 1.5), ("1995-07", "USD", "AUD", 1.7), ("1995-08", "USD", "AUD", None), ("1996-01", "USD", "AUD", 2.0), ("1996-01", "GBP", "AUD", 3.0), ("bad", "USD", "AUD", 9.0)]
    n = F.col("id")
    month = F.make_date((1994 + F.floor(n / 36)).cast("int"), (n % 12 + 1).cast("int"), F.lit(5))
    currency = F.element_at(F.array(*[F.lit(c) for c in ("USD", "GBP", "AUD", "XXX")]), (n % 4 + 1).cast("int"))
    df = spark.range(144).select(n, F.when(n % 17 > 0, month).alias("invoice_date"), currency.alias("original_currency"), F.lit(10.0).alias("original_amount"))
    out = ingest.convert(df, spark.createDataFrame(rates, reference.FX_SCHEMA))
    assert plan_of(out).count("Range (") == 1
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    known = {"USD": {1995 * 12 + 1: 1.5, 1995 * 12 + 7: 1.7, 1996 * 12 + 1: 2.0}, "GBP": {1996 * 12 + 1: 3.0}}
    for r in out.collect():
        have, at = known.get(r.original_currency), r.invoice_date and r.invoice_date.year * 12 + r.invoice_date.month
        if r.original_currency == "AUD":
            want = 1.0, None
        elif at is None:
            want = None, "MISSING_DATE"
        elif have is None:
            want = None, "UNKNOWN_CURRENCY_PAIR"
        else:
            near = min(have, key=lambda m: (abs(m - at), m))
            want = have[near], None if near == at else "RATE_ESTIMATE"
        assert (r.fx_rate, r.fx_warning) == want and r.base_amount == round(10 * (want[0] or 1), 2)


def test_a_date_is_looked_at_once(spark):
    plan = plan_of(spark.range(3).select(dates.parse_date(F.col("id").cast("string")).alias("d"))).lower()
    assert plan.count("trim(") <= 2


def test_white_space_is_what_a_pattern_says(spark):
    letters = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(x + "a" + x + "b" + x,) for x in letters] + [(x,) for x in letters], "c string").repartition(4)
    assert df.where(~text.strip(F.col("c")).eqNullSafe(F.regexp_replace("c", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_only_rows_whose_key_occurs_twice_are_moved(spark, monkeypatch):
    moved = []
    plain = ingest.insert_absent
    monkeypatch.setattr(ingest, "insert_absent", lambda rows, *more: moved.append(rows.count()) or plain(rows, *more))
    rows = [("E1", f"h{n}", n) for n in range(50)] + [("E1", "h3", 3), (None, "h3", 0), (None, "h3", 0), ("E1", None, 1)]
    df = spark.createDataFrame(rows, "engagement_id string, source_row_hash string, v long")
    landed = spark.createDataFrame([("E1", "h7"), ("E1", "h99"), (None, "h50")], "engagement_id string, source_row_hash string")
    got, want = (sorted(map(repr, f(df, landed).collect())) for f in (ingest.absent_rows, plain))
    assert got == want and len(got) == 51
    assert moved == [5]
    assert ingest.absent_rows(df.limit(0), landed).count() == 0


def test_promotion_looks_at_names_and_descriptions_once(spark, plans, monkeypatch):
    """No pass but the one that writes the rows reads what the rows were made from as a whole."""
    noted = runs.stored
    for module in (suppliers, categorise, ingest):
        monkeypatch.setattr(module, "stored", noted)
    queue = spark.createDataFrame([(f"h{n}", "E1", "1", " Acme " if n % 2 else "Bolt Ltd", f"V{n % 2}", "toner" if n % 3 else "x y", "6400", 1.0, '{"INV_NO": "INV-1"}', "queued") for n in range(12)], schema.LANDING_SCHEMA.rpartition(",")[0]).withColumn("ingested_at", F.current_timestamp())
    none = [spark.createDataFrame([], s) for s in (schema.TRANSACTION_SCHEMA, schema.MASTER_SCHEMA, schema.MATCH_LOG_SCHEMA, reference.SEED_SCHEMA, schema.OVERRIDE_SCHEMA)]
    done = runs.promote(queue, *none)
    assert sum("VENDOR_NAME" in p for p in plans) == 1  # the columns that are read from the JSON
    assert sum("toner" in p.lower() for p in plans) <= 1
    assert done.counts.first().asDict() == {"promoted": 8, "review_required": 4}
    assert {(f.canonical_supplier_name, f.category_l2, f.invoice_number) for f in done.facts.collect()} == {("Acme", "Print Consumables", "INV-1"), ("Bolt Ltd", "Print Consumables", "INV-1")}
    assert sorted(r.status for r in done.landing.collect()) == ["processed"] * 8 + ["review_required"] * 4


def test_no_table_that_grows_with_the_names_is_broadcast(spark, monkeypatch):
    seen = []
    write = scratch.stored
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(suppliers, "stored", lambda df, *more, **also: seen.append(physical(df)) or write(df, *more, **also))
    rows = spark.range(60).selectExpr("concat('Supplier#', lpad(id, 6, '0')) AS raw_supplier_name", "concat('V', id) AS raw_supplier_id")
    master = suppliers.build_master(suppliers.distinct_names(rows.where("raw_supplier_id not like '%7'")))
    grown, log = suppliers.harmonise(rows, master)
    seen += [physical(grown), physical(log)]
    assert sum("SortMergeJoin" in p for p in seen) >= 4 and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in seen)
    assert log.where("match_method like 'FUZZY%'").count() == 6 and grown.count() == 60


@pytest.mark.parametrize("postings", [1, 1000])
def test_a_word_that_is_rare_on_neither_side_is_not_multiplied(spark, monkeypatch, postings):
    monkeypatch.setattr(similar, "POSTINGS", postings)
    names = spark.createDataFrame([(f"supplier {n:09d}",) for n in range(20)] + [("gamma works holding",), ("delta",)], "name string")
    known = spark.createDataFrame([(f"supplier {n:09d}", f"c{n}") for n in range(100, 140)] + [("gamma", "g"), ("delta metal works of the north", "d")], "candidate string, canonical_supplier_id string")
    rows = []
    monkeypatch.setattr(F, "sequence", lambda a, b, sequence=F.sequence: rows.append(b) or sequence(a, b))
    out = similar.by_words(names, known, 0.5)
    least = {(n.name, k.candidate): fuzzy.composite(n.name, k.candidate) for n in names.collect() for k in known.collect()}
    for r in out.collect():
        assert abs(least[r.name, r.supplier.candidate] - r.score) < 1e-9
    assert {(r.name, r.supplier.candidate) for r in out.collect()} >= {("gamma works holding", "gamma"), ("delta", "delta metal works of the north")}
    assert "left_semi" in plan_of(out).lower().replace("leftsemi", "left_semi") and len(rows) == 2


def test_distinct_names_sort_no_rows(spark, monkeypatch):
    seen = []
    write = scratch.stored
    monkeypatch.setattr(suppliers, "stored", lambda df, *more, **also: seen.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *more, **also))
    rows = spark.range(200).selectExpr("concat('Acme ', id % 3) AS raw_supplier_name", "concat('V', id % 7) AS raw_supplier_id")
    assert {r.raw_supplier_id for r in suppliers.distinct_names(rows).collect()} == {"V0"}
    over_rows = [p for p in seen if "Range (" in p]
    assert over_rows and not any("SortAggregate" in p for p in over_rows)
