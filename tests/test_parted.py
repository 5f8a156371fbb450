"""Tables in folders: batches and changes read and write the folders they touch, and no others."""

import os

import pytest
from pyspark.sql import functions as F

from outlay import schema
from outlay.operators import changes, ingest
from outlay.sources import parted
from outlay.streaming import landing

FACTS = "transaction_id string, engagement_id string, status string, amount double"


def upload(spark, tenant, numbers):
    rows = spark.createDataFrame([(f"h{n}", tenant, "Acme", float(n)) for n in numbers], "source_row_hash string, engagement_id string, raw_supplier_name string, base_amount double")
    return ingest.to_landing(rows, "")


def files(path):
    out = {}
    for at, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out[os.path.relpath(f"{at}/{n}", path)] = open(f"{at}/{n}", "rb").read()
    return out


def folder(file):
    return tuple(x.partition("=")[2] for x in file.split("/") if x.startswith((parted.TENANT, parted.PREFIX)))


def test_a_batch_reads_only_its_folders(spark, tmp_path, monkeypatch):
    tables, lines = str(tmp_path / "landing"), str(tmp_path / "ledger")
    landing.land_batch(upload(spark, "E1", range(200)), 0, tables, lines, "E1")
    landing.land_batch(upload(spark, "E2=x, {y}", range(200)), 1, tables, lines, "E2")
    read, read_folders = [], parted.read_folders

    def noted(*args):
        out = read_folders(*args)
        read.extend(out.inputFiles())
        return out

    monkeypatch.setattr(parted, "read_folders", noted)
    prefixes = {r.p for r in upload(spark, "E1", [3, 4, 5]).select(parted.prefix(F.col("source_row_hash")).alias("p")).collect()}
    landing.land_batch(upload(spark, "E1", [3, 4, 5, 3]), 2, tables, lines, "E1")
    assert read and {folder(f) for f in read} == {("E1", p) for p in prefixes} and len(prefixes) < 16
    read.clear()
    landing.land_batch(upload(spark, "E2=x, {y}", [7, 1000]), 3, tables, lines, "E2")
    assert read and all("E2" in f for f in read)
    read.clear()
    landing.land_batch(upload(spark, "E3", [1]), 4, tables, lines, "E3")
    assert not read
    for _ in range(2):  # again after a failure: nothing changes
        landing.land_batch(upload(spark, "E1", [3, 4, 5, 3]), 2, tables, lines, "E1")
        got = [(r.rows, r.new_rows, r.duplicate_rows) for r in landing.ledger(spark, lines).orderBy("batch_id").collect()]
        assert got == [(200, 200, 0), (200, 200, 0), (4, 0, 4), (2, 1, 1), (1, 1, 0)]
        assert landing.landed(spark, tables).count() == 402


def test_a_batch_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = upload(spark, "E1", list(range(50)) * 2)
    rows = rows.mapInArrow(noted, rows.schema)
    landing.land_batch(rows, 0, str(tmp_path / "a"), str(tmp_path / "b"), "E1")
    assert seen.value == 100 and landing.ledger(spark, str(tmp_path / "b")).first().duplicate_rows == 50


def test_an_empty_batch(spark, tmp_path):
    landing.land_batch(upload(spark, "E1", []), 0, str(tmp_path / "a"), str(tmp_path / "b"), "E1")
    assert landing.landed(spark, str(tmp_path / "a")).count() == 0 and landing.ledger(spark, str(tmp_path / "b")).first().new_rows == 0


def test_the_queue_is_read_by_tenant_and_batch(spark, tmp_path):
    tables = str(tmp_path / "landing")
    for n, tenant in enumerate(("E1", "E2", "E1")):
        landing.land_batch(upload(spark, tenant, range(n * 20, n * 20 + 20)), n, tables, str(tmp_path / "ledger"), tenant)
    queue = ingest.queued(landing.landed(spark, tables), "E1", f"{2:012d}")
    plan = queue._jdf.queryExecution().executedPlan().toString()
    assert queue.count() == 20 and "PartitionFilters: [isnotnull(engagement_id" in plan and "(batch_id" in plan.partition("PartitionFilters")[2]
    every = set(landing.landed(spark, tables).inputFiles())
    used = {r.f for r in queue.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(used) < len(every) / 2


@pytest.fixture
def facts(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.range(300).select(F.concat(F.lit("t"), "id").alias("transaction_id"), F.concat(F.lit("E"), (F.col("id") % 3).cast("string")).alias("engagement_id"), F.lit("queued").alias("status"), F.col("id").cast("double").alias("amount"))
    parted.create(rows, path, FACTS, "transaction_id")
    return path


def processed(rows, news):
    return changes.set_status(rows, news, "transaction_id", "processed")


def test_a_change_leaves_other_folders_as_they_are(spark, facts):
    before = files(facts)
    news = spark.createDataFrame([("t3", "E0"), ("t6", "E0"), ("t9999", "E0")], "transaction_id string, engagement_id string")
    found = parted.change(spark, facts, FACTS, "transaction_id", news, processed)
    after = files(facts)
    assert all(after[f] == data for f, data in before.items())
    assert {folder(f) for f in after.keys() - before.keys() if f.startswith("data")} <= {(p[0], p[1]) for p in found}
    rows = parted.read(spark, facts, FACTS).collect()
    assert len(rows) == 300 and {r.transaction_id for r in rows if r.status == "processed"} == {"t3", "t6"}
    assert len({r.transaction_id for r in rows}) == 300
    one = parted.read(spark, facts, FACTS, tenants=["E1"])
    assert one.count() == 100 and all("engagement_id=E1" in f for f in one.inputFiles())


def test_a_lost_writer_changes_nothing(spark, facts, monkeypatch):
    news = spark.createDataFrame([("t3", "E0")], "transaction_id string, engagement_id string")
    with monkeypatch.context() as m:
        # lost after the rows were written, before they were published
        m.setattr(parted, "read_table", lambda spark, path, *a, f=parted.read_table: (_ for _ in ()).throw(RuntimeError("lost")) if "version=" in str(path) and "*" in str(path) else f(spark, path, *a))
        with pytest.raises(RuntimeError, match="lost"):
            parted.change(spark, facts, FACTS, "transaction_id", news, processed)
    assert parted.read(spark, facts, FACTS).where("status = 'processed'").count() == 0 and parted.read(spark, facts, FACTS).count() == 300
    parted.change(spark, facts, FACTS, "transaction_id", news, processed)
    assert parted.read(spark, facts, FACTS).where("status = 'processed'").count() == 1 and parted.read(spark, facts, FACTS).count() == 300


def test_rows_can_be_removed_and_added(spark, facts):
    every = spark.range(300).select(F.concat(F.lit("t"), "id").alias("transaction_id"), F.concat(F.lit("E"), (F.col("id") % 3).cast("string")).alias("engagement_id"))
    parted.change(spark, facts, FACTS, "transaction_id", every.where("engagement_id = 'E2'"), lambda rows, news: rows.limit(0))
    assert {r.engagement_id for r in parted.read(spark, facts, FACTS).select("engagement_id").distinct().collect()} == {"E0", "E1"}
    new = spark.createDataFrame([("n1", "E9", "queued", 1.0)], FACTS)
    parted.change(spark, facts, FACTS, "transaction_id", new, lambda rows, news: rows.unionByName(news))
    assert parted.read(spark, facts, FACTS).count() == 201
    assert parted.change(spark, facts, FACTS, "transaction_id", new.limit(0), processed) == []
    assert schema.LANDING_SCHEMA
