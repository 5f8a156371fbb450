"""Whole runs over small tables: promotion, landing as a stream, made-up sources, evaluation."""

import pytest
from pyspark.sql import functions as F

from outlay import reference, schema
from outlay.operators import ingest, recommend, runs
from outlay.sources import files, synthetic
from outlay.sources.scratch import stored
from outlay.sources.warehouse import transactions
from outlay.streaming import landing


def empty(spark, fields):
    return spark.createDataFrame([], fields)


def promoted(spark, landed, facts=None):
    seeds = empty(spark, reference.SEED_SCHEMA)
    return runs.promote(landed, facts if facts is not None else empty(spark, schema.TRANSACTION_SCHEMA), empty(spark, schema.MASTER_SCHEMA), empty(spark, schema.MATCH_LOG_SCHEMA), seeds, empty(spark, schema.OVERRIDE_SCHEMA))


def landing_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text("VENDOR_NAME,INV_NO,INV_DATE,LINE_DESC,AMT,CCY,GL_CODE,PAY_TERMS\nAcme P/L,INV-1,15/03/2024,toner cartridge,100.50,AUD,0642,Net 30\n,CN-2,2024-03-18,xyzzy,-5,AUD,2100,N/A\n")
    raw = files.read_export(spark, str(tmp_path / "in.csv"))
    return stored(ingest.to_landing(ingest.ingest(raw, empty(spark, reference.FX_SCHEMA), "E1"), "b1"), "landed")


def test_promote(spark, tmp_path):
    landed = landing_rows(spark, tmp_path)
    done = promoted(spark, landed)
    assert done.counts.first().asDict() == {"promoted": 1, "review_required": 1}
    fact = done.facts.collect()
    assert [(f.invoice_number, f.category_method, f.payment_terms_days, str(f.invoice_date), f.base_amount) for f in fact] == [("INV-1", "KEYWORD", 30, "2024-03-15", 100.5)]
    assert fact[0].canonical_supplier_name == "Acme P/L" and done.master.count() == 1
    assert sorted(r.status for r in done.landing.collect()) == ["processed", "review_required"]
    again = promoted(spark, landed, stored(done.facts, "facts"))
    assert again.facts.count() == 1


def test_promote_nothing(spark, tmp_path):
    done = promoted(spark, landing_rows(spark, tmp_path).withColumn("status", F.lit("processed")))
    assert done.counts.first().asDict() == {"promoted": 0, "review_required": 0}
    assert done.facts.count() == 0 and done.landing.count() == 2


def test_stream_lands_each_row_once(spark, tmp_path):
    source = tmp_path / "uploads"
    source.mkdir()
    tables, lines, state = (str(tmp_path / n) for n in ("landing", "ledger", "state"))
    progress = landing.Progress()
    spark.streams.addListener(progress)
    prepare = landing.exports_to_landing(empty(spark, reference.FX_SCHEMA), "E1")

    def go():
        query = landing.land(landing.watch_exports(spark, str(source)), prepare, tables, lines, state, "E1")
        query.awaitTermination()
        return query

    header = ",".join(reference.COLUMN_MAPPINGS["DEFAULT"]) + "\n"
    line = lambda n: f"Acme,V-1,INV-{n},2024-03-15,toner,10.00,AUD,6420,CC-1,Net 30,,Corporate,Sydney\n"
    (source / "a.csv").write_text(header + line(1) + line(2) + line(1))
    go()
    (source / "b.csv").write_text(header + line(2) + line(3))
    go()
    assert landing.landed(spark, tables).count() == 3
    got = [(r.rows, r.new_rows, r.duplicate_rows, r.status) for r in landing.ledger(spark, lines).orderBy("batch_id").collect()]
    assert got == [(3, 2, 1, "done"), (2, 1, 1, "done")]
    # a batch that is repeated after a failure changes nothing
    batch = files.read_export(spark, str(source / "b.csv"))
    landing.land_batch(prepare(batch), 1, tables, lines, "E1")
    assert landing.landed(spark, tables).count() == 3 and landing.ledger(spark, lines).count() == 2
    spark.streams.removeListener(progress)


def test_export_does_not_depend_on_partitions(spark):
    a = synthetic.export(spark, 500)
    assert a.columns == list(reference.COLUMN_MAPPINGS["DEFAULT"])
    rows = a.collect()
    assert sorted(rows) == sorted(a.repartition(7).collect()) and len(rows) == 500
    assert sorted(synthetic.export(spark, 500, seed=1).collect()) != sorted(rows)
    tidy = synthetic.export(spark, 200, messiness=0.0, credit_notes=0.0, without_currency=0.0)
    assert tidy.where("INV_DATE not rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' or AMT like '-%' or CCY = ''").count() == 0
    assert synthetic.export(spark, 0).count() == 0
    assert ingest.ingest(a, synthetic.fx_series(spark, {"USD": (0.6, 0.7)}), "E1").where("invoice_date is null").count() == 0


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """500 transactions, written once."""
    path = str(tmp_path_factory.mktemp("few") / "t")
    transactions(spark, "/root/testdata/sf0.001").orderBy("transaction_id").limit(500).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("rows", [500, 0])
def test_evaluate(few, rows):
    df = few.where(F.lit(rows > 0))
    got = {(r.section, r.metric): r for r in runs.evaluate(df, recommend.portfolio(recommend.allocate(recommend.generate(df)), df)).collect()}
    assert got["ingestion", "row_count"].value == (df.count())
    assert got["overall", "verdict"].verdict in ("PASS", "FAIL")
    if rows == 0:
        assert got["categorisation", "coverage_pct"].verdict == "FAIL"


def test_run_writes_all_tables(spark, few, tmp_path):
    runs.run(few, str(tmp_path / "out"))
    back = files.read_views(spark, str(tmp_path / "out"), "by_supplier", "abc", "kpis", "transactions", "diagnostics")
    assert back["transactions"].count() == 500 and back["kpis"].count() == 1 and back["diagnostics"].count() == 9
    assert {"abc_segment", "is_tail_spend"} <= set(back["transactions"].columns)
