"""Queries over whole runs: made-up sources, landing as a stream, promotion, evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay import schema
from outlay.operators import recommend, runs
from outlay.plans import resolve
from outlay.plans.book import Book
from outlay.plans.insight import book as insight_book
from outlay.sources import synthetic
from outlay.sources.scratch import new_folder, stored
from outlay.sources.warehouse import TRANSACTIONS_SQL, transactions
from outlay.streaming import landing

book = Book()

# made-up sources
SEED = 42


def order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up rows are numbered by the orders."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))


FX_RANGES = {"USD": (0.62, 0.69), "EUR": (0.57, 0.64), "GBP": (0.50, 0.54)}
_U = lambda name, row="i": f"(('0x' || substr(md5('{SEED}|{name}|' || {row}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_PICK = lambda values, u: f"{list(values)!r}[floor({u} * {len(values)})::INT + 1]"


def _currency_sql() -> str:
    until, out = 0.0, "CASE"
    for value, part in synthetic.CURRENCY_SHARES.items():
        until += part
        out += f" WHEN {_U('currency')} < {round(until, 6)}::DOUBLE THEN '{value}'"
    return out + " ELSE 'AUD' END"


book.add("synthetic_export", lambda spark, sf_dir: synthetic.export(spark, order_numbers(spark, sf_dir), SEED), f"""
WITH r AS (SELECT i, {_U('credit')} < 0.05 AS credit, {_U('internal')} < 0.02 AS internal, {_U('messy')} AS form, {_U('amount')} AS amount, {_PICK(synthetic.LINES, _U('line'))} AS line, {_PICK(synthetic.TERMS, _U('terms'))} AS terms,
    DATE '{synthetic.FIRST_DAY}' + floor({_U('day')} * {synthetic.DAYS})::INT AS day, lpad(CASE WHEN {_U('anchor')} < 0.4 THEN floor({_U('supplier')} * 10) ELSE floor({_U('supplier')} * 500) END::BIGINT::VARCHAR, 6, '0') AS s FROM (SELECT o_orderkey AS i FROM orders) q)
SELECT CASE WHEN internal THEN 'INTERCOMPANY - ' || {_PICK(synthetic.DEPARTMENTS, _U('department'))} WHEN {_U('variant')} < 0.15 THEN 'SUPPLIER ' || s || ' ' || {_PICK(synthetic.FORMS, _U('form'))} ELSE 'Supplier ' || s || ' {synthetic.FORMS[0]}' END AS VENDOR_NAME,
  CASE WHEN internal THEN 'V-INTCO' ELSE 'V-' || s END AS VENDOR_NUM, CASE WHEN credit THEN 'CN-' ELSE 'INV-' END || year(day) || '-' || lpad((i + 1)::VARCHAR, 9, '0') AS INV_NO,
  CASE WHEN form >= 0.3 THEN strftime(day, '%Y-%m-%d') WHEN form < 0.3 * 0.6 THEN strftime(day, '%d/%m/%Y') ELSE strftime(day, '%d-%b-%Y') END AS INV_DATE,
  CASE WHEN credit THEN 'Credit ' || lower(line) ELSE line END AS LINE_DESC, CASE WHEN credit THEN printf('-%.2f', (50 + floor(amount * 495000) / 100)::DOUBLE) ELSE printf('%.2f', (100 + floor(amount * 4990000) / 100)::DOUBLE) END AS AMT,
  CASE WHEN internal THEN 'AUD' WHEN {_U('no currency')} < 0.02 THEN '' ELSE {_currency_sql()} END AS CCY, floor(6000 + {_U('code')} * 1000)::BIGINT::VARCHAR AS GL_CODE,
  CASE WHEN {_U('no centre')} < 0.05 THEN '' ELSE 'CC-' || lpad((floor({_U('centre')} * 20)::BIGINT + 1)::VARCHAR, 2, '0') END AS COST_CTR,
  CASE WHEN {_U('no terms')} < 0.05 THEN '' WHEN {_U('terms form')} < 0.3 THEN upper(replace(terms, ' ', '')) ELSE terms END AS PAY_TERMS,
  CASE WHEN credit OR {_U('no order')} < 0.2 THEN '' ELSE 'PO-' || lpad(floor({_U('order')} * 1000000)::BIGINT::VARCHAR, 6, '0') END AS PO_NUM, {_PICK(synthetic.UNITS, _U('unit'))} AS BUS_UNIT, {_PICK(synthetic.SITES, _U('site'))} AS SITE FROM r""")

book.add("synthetic_fx", lambda spark, sf_dir: synthetic.fx_series(spark, FX_RANGES, seed=SEED, listed_months=order_months(spark, sf_dir)), f"""
WITH c(ccy, low, high) AS (VALUES {', '.join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE)" for c, (a, b) in FX_RANGES.items())}), m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS year_month FROM orders),
r AS (SELECT year_month, ccy, round(low + {_U('rate', "ccy || year_month")} * (high - low), 4) AS rate FROM m, c)
SELECT year_month, 'AUD' AS from_ccy, ccy AS to_ccy, rate FROM r UNION ALL SELECT year_month, ccy, 'AUD', round(1 / rate, 6) FROM r""")


# landing as a stream: an order's customer is the row's content, so that rows repeat
def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, lines = new_folder(spark, "landing"), new_folder(spark, "ledger")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    # the file source reads folders and patterns
    stream = spark.readStream.schema(orders).parquet(f"{sf_dir}/orders.parque[t]")

    def prepare(batch: DataFrame) -> DataFrame:
        customer = F.col("o_custkey").cast("string")
        none = [F.lit(None).cast("string").alias(c) for c in ("raw_supplier_id", "raw_line_description", "gl_account", "raw_data")]
        return batch.select(F.md5(customer.cast("binary")).alias("source_row_hash"), F.lit("E1").alias("engagement_id"), F.concat(F.lit("Customer "), customer).alias("raw_supplier_name"), F.col("o_totalprice").alias("base_amount"), *none, F.lit("queued").alias("status"), F.current_timestamp().alias("ingested_at"))

    for _ in range(2):  # the second start finds nothing new
        landing.land(stream, prepare, tables, lines, f"{lines}-state", "E1").awaitTermination()
    return landing.ledger(spark, lines).select("engagement_id", "status", "rows", "new_rows", "duplicate_rows")


book.add("stream_landing", stream_landing, "SELECT 'E1' AS engagement_id, 'done' AS status, count(*) AS rows, count(DISTINCT o_custkey) AS new_rows, count(*) - count(DISTINCT o_custkey) AS duplicate_rows FROM orders")


# promotion of all transactions as one batch, without suppliers or decisions known before
def promote_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve._said(transactions(spark, sf_dir, "transaction_id", "engagement_id", "raw_supplier_name", "raw_supplier_id", "raw_line_description", "gl_account", "base_amount", "payment_terms_days"))
    queue = rows.drop("payment_terms_days").withColumnRenamed("transaction_id", "source_row_hash").withColumns({"batch_id": F.lit("1"), "status": F.lit("queued"), "raw_data": F.lit("{}"), "ingested_at": F.current_timestamp()})
    empty = lambda fields: spark.createDataFrame([], fields)
    done = runs.promote(queue, empty(schema.TRANSACTION_SCHEMA), empty(schema.MASTER_SCHEMA), empty(schema.MATCH_LOG_SCHEMA), resolve._seeds(spark), empty(schema.OVERRIDE_SCHEMA), batch_id="1")
    facts = done.facts.groupBy("engagement_id", "category_method").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("canonical_supplier_id").alias("suppliers"))
    waiting = done.landing.where("status = 'review_required'").groupBy("engagement_id").agg(F.count(F.lit(1)).alias("facts")).withColumns({"category_method": F.lit("none"), "suppliers": F.lit(0).cast("long")})
    return facts.unionByName(waiting)


book.add("promote_batch", promote_batch, f"""
WITH {TRANSACTIONS_SQL}{resolve._PARTS}, p AS (SELECT engagement_id, raw_supplier_name AS s, CASE WHEN g.l1 IS NOT NULL THEN 'GL_MAPPING' WHEN v.l1 IS NOT NULL THEN 'SUPPLIER_MAPPING' WHEN w.c >= 0.6 THEN 'KEYWORD' ELSE 'none' END AS category_method
  FROM (SELECT *, {resolve._WORDS} AS i FROM (SELECT *, lower(' ' || coalesce(raw_line_description, '') || {resolve._MORE}) AS d FROM t)) r LEFT JOIN g ON code = ltrim(gl_account, '0') LEFT JOIN v ON name = lower(raw_supplier_name) LEFT JOIN w USING (i))
SELECT engagement_id, category_method, count(*) AS facts, CASE WHEN category_method = 'none' THEN 0 ELSE count(DISTINCT s) END AS suppliers FROM p GROUP BY 1, 2""")


# evaluation
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transactions(spark, sf_dir)
    cells = stored(recommend.cells(df), "cells")
    return runs.evaluate(df, recommend.portfolio(recommend.allocate(recommend.generate(cells)), cells))


_GATE = lambda c, gates: f"CASE WHEN {c} >= {gates[0]} THEN 'PASS' WHEN {c} >= {gates[1]} THEN 'WARN' ELSE 'FAIL' END"
_C = "coalesce(category_confidence, 0)"
_PART = lambda c: f"round((count(*) FILTER ({c}))::DOUBLE / count(*), 4)"
book.add("evaluation", evaluation, f"""
WITH {TRANSACTIONS_SQL}, s AS ({insight_book.sql['savings_portfolio']}), e AS (SELECT count(*) AS n, count(*) FILTER (base_amount < 0 OR starts_with(invoice_number, 'CN-')) AS credit, count(*) FILTER (is_intercompany = 1) AS internal, count(DISTINCT canonical_supplier_id) AS suppliers,
  count(*) FILTER (canonical_supplier_id IS NULL) AS unmatched, {_PART(f'{_C} >= 0.6')} AS coverage, count(*) FILTER (category_confidence IS NULL) AS uncategorised, {_PART(f'{_C} >= 0.85')} AS high, {_PART(f'{_C} >= 0.6 AND {_C} < 0.85')} AS medium, {_PART(f'{_C} < 0.6')} AS low FROM t),
v AS (SELECT *, {_GATE('coverage', runs.COVERAGE_GATES)} AS v1, {_GATE('recommendations', runs.COUNT_GATES)} AS v2, CASE WHEN coalesce(plausible, true) THEN 'PASS' ELSE 'FAIL' END AS v3 FROM e, s), w AS (SELECT *, 'FAIL' IN (v1, v2, v3) AS failed FROM v)
SELECT * FROM (SELECT unnest(['ingestion', 'ingestion', 'ingestion', 'harmonisation', 'harmonisation', 'categorisation', 'categorisation', 'categorisation', 'categorisation', 'categorisation', 'recommendations', 'recommendations', 'recommendations', 'overall']) AS section,
  unnest(['row_count', 'credit_notes', 'intercompany', 'canonical_suppliers', 'unmatched', 'coverage_pct', 'uncategorised', 'high_pct', 'medium_pct', 'low_pct', 'count', 'total_savings', 'savings_pct', 'verdict']) AS metric,
  unnest([n, credit, internal, suppliers, unmatched, coverage, uncategorised, high, medium, low, recommendations, total_savings, coalesce(savings_pct, 0), failed::INT]::DOUBLE[]) AS value,
  unnest([NULL, NULL, NULL, NULL, NULL, v1, NULL, NULL, NULL, NULL, v2, NULL, v3, CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END]) AS verdict FROM w)""")
