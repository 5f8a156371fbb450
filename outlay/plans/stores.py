"""Queries over stored tables: changes, review queues, files written and read back, a whole run; with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay import reference, schema
from outlay.functions import numbers, text
from outlay.operators import categorise, changes, cube, filters, presentation, quality, recommend, runs, segments, suppliers
from outlay.plans import insight, operate, resolve, spend
from outlay.plans.book import Book
from outlay.sources import files, parted, synthetic
from outlay.sources.scratch import new_folder, stored
from outlay.sources.warehouse import EXPORT_SQL, TRANSACTIONS_SQL, export, transactions

book = Book()
SPEND = spend.SPEND


def _add(name: str, columns: tuple[str, ...], operator, sql: str) -> None:
    book.add(name, lambda spark, sf_dir: operator(transactions(spark, sf_dir, *dict.fromkeys(columns))), f"WITH {TRANSACTIONS_SQL}{sql}")


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


# the other problem filters, and what a page shows of them
for _check, _where in {"uncategorised_spend": "category_l1 IS NULL", "missing_payment_terms": "payment_terms_days IS NULL", "weak_descriptions": spend._WEAK + r"len(string_split_regex(trim(raw_line_description), '\s+')) < 5"}.items():
    _add(f"problem_rows_{_check}", ("transaction_id", "category_l1", "payment_terms_days", "raw_line_description"), lambda df, c=_check: filters.problem_rows(df, c).select("transaction_id"), f" SELECT transaction_id FROM t WHERE {_where}")
_add("problem_columns", ("transaction_id", "invoice_number", "raw_supplier_name", "base_amount", "category_l1", "po_number", "contract_id"), lambda df: filters.problem_page(df, "missing_contract_linkage"), " SELECT transaction_id, invoice_number, raw_supplier_name, base_amount::DOUBLE AS base_amount FROM t WHERE po_number IS NULL AND contract_id IS NULL ORDER BY abs(base_amount) DESC, transaction_id LIMIT 200")
_add("owned_rows", ("engagement_id", "base_amount"), lambda df: _count(filters.owned(df, df.sparkSession.createDataFrame([("E0", "me"), ("E1", "you"), ("E2", "me")], "engagement_id string, owner string"), "me"), "engagement_id"), " SELECT engagement_id, count(*) AS rows FROM t WHERE engagement_id IN ('E0', 'E2') GROUP BY 1")
_add("checks_by_severity", spend._CHECKED, lambda df: quality.by_severity(quality.diagnose(df)), f"{spend._BY_WORDS} SELECT * FROM d")
_add("latest_rows", ("transaction_id", "ingested_at", "payment_terms_days"), lambda df: filters.latest(df.select("transaction_id", F.when(F.col("payment_terms_days") != 30, F.col("ingested_at")).alias("ingested_at")), "ingested_at", 50, "transaction_id"), " SELECT transaction_id, CASE WHEN payment_terms_days <> 30 THEN ingested_at END AS ingested_at FROM t ORDER BY 2 DESC NULLS LAST, 1 LIMIT 50")

# table changes
_add("set_status", ("transaction_id", "engagement_id"), lambda df: _count(changes.set_status(df.withColumn("status", F.lit("queued")), df.where("engagement_id = 'E0'"), "transaction_id", "processed"), "engagement_id", "status"), " SELECT engagement_id, CASE WHEN engagement_id = 'E0' THEN 'processed' ELSE 'queued' END AS status, count(*) AS rows FROM t GROUP BY 1, 2")


def _set_categories(df: DataFrame) -> DataFrame:
    news = {"category_l1": F.lit("New"), "category_l2": F.lit("Newer"), "category_l3": F.lit(None).cast("string"), "unspsc_code": F.lit("99"), "category_confidence": F.lit(0.5), "category_method": F.lit("MANUAL")}
    df = df.withColumns({"category_l3": F.lit("x"), "unspsc_code": F.lit("1"), "category_confidence": F.lit(0.9), "manual_override_flag": F.lit(0), "categorisation_status": F.lit("categorised")})
    return _count(changes.set_categories(df, df.where("payment_terms_days = 30").withColumns(news)), "category_l1", "category_method", "manual_override_flag", "categorisation_status")


_add("set_categories", ("transaction_id", "payment_terms_days", "category_l1", "category_l2", "category_method"), _set_categories, """, n AS (SELECT *, coalesce(payment_terms_days = 30, false) AS new FROM t)
SELECT CASE WHEN new THEN 'New' ELSE category_l1 END AS category_l1, CASE WHEN new THEN 'MANUAL' ELSE category_method END AS category_method, new::INT AS manual_override_flag, CASE WHEN new THEN 'review_required' ELSE 'categorised' END AS categorisation_status, count(*) AS rows FROM n GROUP BY ALL""")
_add("set_segments", ("engagement_id", "canonical_supplier_id", *SPEND), lambda df: _count(changes.set_segments(df, segments.abc(df)), "engagement_id", "abc_segment"), f""", z AS ({spend.book.sql['abc_rows']})
SELECT t.engagement_id, abc_segment, count(*) AS rows FROM t LEFT JOIN z ON z.engagement_id = t.engagement_id AND z.canonical_supplier_id = t.canonical_supplier_id GROUP BY 1, 2""")

# the match log, its reviews, and the master; each tenth of suppliers is less sure
_LOG_SQL = "l AS (SELECT s_name AS raw_supplier_name, 'V-' || s_suppkey AS raw_supplier_id, 'c' || (s_suppkey // 3) AS canonical_supplier_id, 'FUZZY_REVIEW' AS match_method, (s_suppkey % 10)::DOUBLE / 10 AS confidence, CASE WHEN s_suppkey % 10 < 7 THEN 'PENDING' ELSE 'APPROVED' END AS review_status FROM supplier)"
_MASTER_SQL = "m AS (SELECT 'c' || (s_suppkey // 3) AS canonical_supplier_id, s_name AS canonical_name FROM supplier WHERE s_suppkey % 3 = 0)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_name").alias("raw_supplier_name"), F.concat(F.lit("V-"), k.cast("string")).alias("raw_supplier_id"), F.concat(F.lit("c"), F.floor(k / 3).cast("string")).alias("canonical_supplier_id"),
        F.lit("FUZZY_REVIEW").alias("match_method"), ((k % 10).cast("double") / 10).alias("confidence"), F.lit("").alias("evidence"), F.when(k % 10 < 7, "PENDING").otherwise("APPROVED").alias("review_status"),
    )


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, null = F.col("s_suppkey"), F.lit(None).cast("string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").where(k % 3 == 0)
    return rows.select(F.concat(F.lit("c"), F.floor(k / 3).cast("string")).alias("canonical_supplier_id"), F.col("s_name").alias("canonical_name"), null.alias("normalised_name"), null.alias("parent_company_id"), null.alias("parent_name"), null.alias("identifiers"))


_NAME = "Supplier#000000004"
_SEEN = ("raw_supplier_name", "raw_supplier_id", "canonical_supplier_id", "match_method", "confidence", "review_status")
book.add("decide_match", lambda spark, sf_dir: changes.decide(_log(spark, sf_dir), _NAME, "REJECTED").select(*_SEEN), f"WITH {_LOG_SQL} SELECT * REPLACE (CASE WHEN raw_supplier_name = '{_NAME}' THEN 'REJECTED' ELSE review_status END AS review_status) FROM l")
book.add("override_match_log", lambda spark, sf_dir: changes.override_match(_log(spark, sf_dir), transactions(spark, sf_dir, "raw_supplier_name", "canonical_supplier_id", "canonical_supplier_name").withColumn("canonical_supplier_confidence", F.lit(0.5)), _NAME, "c99", "Other")[0].select(*_SEEN), f"""
WITH {_LOG_SQL}, h AS (SELECT *, raw_supplier_name = '{_NAME}' AS hit FROM l)
SELECT raw_supplier_name, raw_supplier_id, CASE WHEN hit THEN 'c99' ELSE canonical_supplier_id END AS canonical_supplier_id, CASE WHEN hit THEN 'MANUAL' ELSE match_method END AS match_method, CASE WHEN hit THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN hit THEN 'OVERRIDDEN' ELSE review_status END AS review_status FROM h""")
book.add("override_match_facts", lambda spark, sf_dir: _count(changes.override_match(_log(spark, sf_dir), transactions(spark, sf_dir, "raw_supplier_name", "canonical_supplier_id", "canonical_supplier_name").withColumn("canonical_supplier_confidence", F.lit(0.5)), _NAME, "c99", "Other")[1], "canonical_supplier_name", "canonical_supplier_confidence"), f"""
WITH {TRANSACTIONS_SQL}, h AS (SELECT *, coalesce(raw_supplier_name = '{_NAME}', false) AS hit FROM t)
SELECT CASE WHEN hit THEN 'Other' ELSE canonical_supplier_name END AS canonical_supplier_name, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS canonical_supplier_confidence, count(*) AS rows FROM h GROUP BY 1, 2""")
book.add("review_queue", lambda spark, sf_dir: suppliers.review_queue(_log(spark, sf_dir), _master(spark, sf_dir), transactions(spark, sf_dir, "raw_supplier_name", "base_amount")).select("raw_supplier_name", "supplier", "confidence", "spend"), f"""
WITH {TRANSACTIONS_SQL}, {_LOG_SQL}, {_MASTER_SQL}, v AS (SELECT raw_supplier_name, sum(base_amount)::DOUBLE AS spend FROM t GROUP BY 1)
SELECT l.raw_supplier_name, coalesce(canonical_name, l.canonical_supplier_id) AS supplier, confidence, coalesce(spend, 0.0) AS spend FROM l LEFT JOIN m USING (canonical_supplier_id) LEFT JOIN v ON v.raw_supplier_name = l.raw_supplier_name WHERE review_status = 'PENDING'""")
book.add("new_log_rows", lambda spark, sf_dir: suppliers.new_log_rows(_log(spark, sf_dir), _log(spark, sf_dir).where("confidence > 0.4")).select("raw_supplier_name"), f"WITH {_LOG_SQL} SELECT raw_supplier_name FROM l WHERE confidence <= 0.4")
book.add("with_parents", lambda spark, sf_dir: suppliers.with_parents(_master(spark, sf_dir), _master(spark, sf_dir).select(F.col("canonical_name").alias("supplier_name"), F.when(F.substring("canonical_name", -1, 1).isin("3", "6"), "Parent A").alias("parent_company_name"))).select("canonical_supplier_id", "parent_company_id", "parent_name"), f"""
WITH {_MASTER_SQL}, p AS (SELECT *, CASE WHEN right(canonical_name, 1) IN ('3', '6') THEN 'Parent A' END AS parent_name FROM m) SELECT canonical_supplier_id, substr(sha256(lower(parent_name)), 1, 12) AS parent_company_id, parent_name FROM p""")
book.add("stored_names", lambda spark, sf_dir: suppliers.with_normalised_name(_master(spark, sf_dir)).select("canonical_supplier_id", "normalised_name"), f"WITH {_MASTER_SQL} SELECT canonical_supplier_id, trim(regexp_replace(lower(canonical_name), '[^a-z0-9_]+', ' ', 'g')) AS normalised_name FROM m")
_add("related_suppliers", ("parent_company_name", "canonical_supplier_name"), suppliers.related, ", o AS (SELECT DISTINCT parent_company_name, canonical_supplier_name FROM t WHERE parent_company_name IS NOT NULL AND canonical_supplier_name IS NOT NULL), n AS (SELECT parent_company_name, count(*) - 1 AS related FROM o GROUP BY 1) SELECT * FROM o JOIN n USING (parent_company_name) WHERE related > 0")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all matches that wait, and one more."""
    waiting = _log(spark, sf_dir).where("review_status = 'PENDING'")
    sure = F.col("confidence") >= 0.4
    rows = waiting.select(F.col("raw_supplier_name").alias("entity_id"), F.when(sure, "approve").otherwise("reject").alias("action"), F.col("review_status").alias("before"), F.when(sure, "APPROVED").otherwise("REJECTED").alias("after"))
    log = changes.audit_all(spark.createDataFrame([], schema.AUDIT_SCHEMA), "match", rows, "me")
    return changes.audit(log, "match", "b", "reject", None, "REJECTED", "you").select("entity", "entity_id", "action", "before", "after", "actor")


book.add("audit_log", _audited, f"""
WITH {_LOG_SQL} SELECT 'match' AS entity, raw_supplier_name AS entity_id, CASE WHEN confidence >= 0.4 THEN 'approve' ELSE 'reject' END AS action, 'PENDING' AS before, CASE WHEN confidence >= 0.4 THEN 'APPROVED' ELSE 'REJECTED' END AS after, 'me' AS actor FROM l WHERE review_status = 'PENDING'
UNION ALL SELECT 'match', 'b', 'reject', NULL, 'REJECTED', 'you'""")


# decisions and vectors
def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback on each supplier, on ledger codes and on nothing, behind the decisions made before; one code's are taken back."""
    k = F.col("s_suppkey")
    feedback = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.when(k % 3 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("canonical_supplier_id"), F.when(k % 3 == 1, (6400 + k % 7).cast("string")).alias("gl_account"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("l1"), F.col("s_name").alias("reviewer"), (k + 100).alias("override_order"),
    )
    out = changes.apply_feedback(resolve._overrides(spark), feedback)
    return changes.remove_rows(out, F.col("gl_account") == "6400").select("canonical_supplier_id", "gl_account", "override_l1", "reviewer", "override_order")


book.add("override_decisions", _decisions, f"""
SELECT * FROM (SELECT sid AS canonical_supplier_id, gl AS gl_account, l1 AS override_l1, 'reviewer' AS reviewer, n::BIGINT AS override_order FROM (VALUES {resolve._values(resolve.OVERRIDES)}) v(sid, gl, l1, n)
UNION ALL SELECT CASE WHEN s_suppkey % 3 = 0 THEN 's' || s_suppkey END, CASE WHEN s_suppkey % 3 = 1 THEN (6400 + s_suppkey % 7)::VARCHAR END, 'Nation ' || s_nationkey, s_name, s_suppkey + 100 FROM supplier WHERE s_suppkey % 3 < 2) WHERE gl_account IS DISTINCT FROM '6400'""")
_vectors = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
book.add("insert_vectors", lambda spark, sf_dir: changes.insert_vectors(_vectors(spark, sf_dir).where("id % 2 = 0"), _vectors(spark, sf_dir)).groupBy((F.col("id") % 2).alias("odd")).agg(F.count(F.lit(1)).alias("rows")), "SELECT vec_id % 2 AS odd, count(*) AS rows FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1")
book.add("vectors_by_keys", lambda spark, sf_dir: suppliers.by_keys(_vectors(spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"))).select("id", F.size(numbers.vector_from_text(numbers.vector_to_text(F.col("vector")))).alias("width")), "SELECT DISTINCT vec_id AS id, len(embedding)::INT AS width FROM embeddings WHERE embedding IS NOT NULL AND vec_id IN (SELECT o_custkey FROM orders)")


def _by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first of each label, taken as categories."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    categories = vectors.groupBy(F.col("label").alias("id")).agg(F.min_by("embedding", "vec_id").alias("vector")).select("id", "vector", F.lit("L").alias("l1"), F.col("id").cast("string").alias("l2"), F.lit("1").alias("unspsc"))
    found = categorise.by_vector(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), categories)
    return found.select("id", F.col("by_vector.l2").alias("l2"), F.round("by_vector.confidence", 6).alias("confidence"))


_S = resolve.DEFAULT
book.add("category_by_vector", _by_vector, f"""
WITH k AS ({resolve.book.sql['cosine_top2']}), p AS (SELECT query_id AS id, max(candidate_id) FILTER (rank = 1) AS l2, max(similarity) FILTER (rank = 1) AS a, max(similarity) FILTER (rank = 2) AS b FROM k GROUP BY 1), d AS (
  SELECT id, l2, CASE WHEN a >= {_S.category_similarity} THEN CASE WHEN coalesce(abs(a - b) <= {_S.category_ambiguous} AND a > {_S.category_ambiguous_above} AND b > {_S.category_ambiguous_above}, false) THEN a * 0.75::DOUBLE ELSE a * 0.9::DOUBLE END END AS c FROM p)
SELECT id, CASE WHEN c IS NOT NULL THEN l2::VARCHAR END AS l2, round(c, 6) AS confidence FROM d""")

# files: written and read back
def _texts_of_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' types, brands and names as a hierarchy."""
    path = new_folder(spark, "hierarchy")
    c = F.col
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(c("p_type").alias("l1_code"), c("p_type").alias("l1_name"), c("p_brand").alias("l2_code"), c("p_brand").alias("l2_name"), c("p_name").alias("l3_code"), c("p_name").alias("l3_name"), F.lit("43").alias("unspsc_segment_code"), F.lit("x").alias("unspsc_segment_name"))
    rows.write.csv(path, header=True)
    return categorise.category_texts(reference.category_hierarchy(spark, path)).select("l1_name", "l2_name", "text")


book.add("category_texts", _texts_of_categories, "SELECT p_type AS l1_name, p_brand AS l2_name, p_type || ' ' || p_brand || ' ' || string_agg(DISTINCT p_name, ' ' ORDER BY p_name) AS text FROM part GROUP BY 1, 2")


def _rates_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for each month of orders."""
    path = new_folder(spark, "rates")
    rows = operate.order_months(spark, sf_dir).groupBy("year_month").agg(F.count(F.lit(1)).alias("n"))
    rows.select("year_month", F.lit("USD").alias("from_ccy"), F.lit("AUD").alias("to_ccy"), F.round(1 + F.col("n") / 4096, 4).alias("rate")).write.csv(path, header=True)
    return reference.fx_rates(spark, path)


book.add("rates_file", _rates_file, "SELECT strftime(o_orderdate, '%Y-%m') AS year_month, 'USD' AS from_ccy, 'AUD' AS to_ccy, round(1 + count(*)::DOUBLE / 4096, 4) AS rate FROM orders GROUP BY 1")


def _export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "export")
    export(spark, sf_dir).write.csv(path, header=True)
    back = files.read_export(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


book.add("export_file", _export_file, f"WITH {TRANSACTIONS_SQL}, {EXPORT_SQL} SELECT * FROM x")


def _views(spark: SparkSession, sf_dir: str, format_: str) -> DataFrame:
    path = new_folder(spark, "views")
    df = transactions(spark, sf_dir, "canonical_supplier_name", "parent_company_name", *spend.LINES)
    files.write_views({"by_supplier": cube.view(df, "canonical_supplier_name", "parent_company_name")}, path, format_)
    if format_ == "parquet":
        return files.read_views(spark, path, "by_supplier")["by_supplier"]
    if format_ == "json":
        return spark.read.schema("canonical_supplier_name string, parent_company_name string, total_spend double, invoice_count long, po_count long, avg_payment_terms double").json(f"{path}/by_supplier")
    return spark.read.csv(f"{path}/by_supplier", header=True, schema="canonical_supplier_name string, parent_company_name string, total_spend double, invoice_count long, po_count long, avg_payment_terms double")


for _format in ("parquet", "csv", "json"):
    book.add(f"views_as_{_format}", lambda spark, sf_dir, f=_format: _views(spark, sf_dir, f), spend.book.sql["cube_by_supplier"])
_TABLES = ("region", "nation", "supplier", "orders")
book.add("table_stats", lambda spark, sf_dir: files.table_stats({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}), " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _TABLES))
_add("batch_status", ("engagement_id", "payment_terms_days"), lambda df: cube.batch_status(df.select(F.col("engagement_id").alias("batch_id"), F.when(F.col("payment_terms_days") == 30, "processed").otherwise("queued").alias("status"))), " SELECT engagement_id AS batch_id, CASE WHEN payment_terms_days = 30 THEN 'processed' ELSE 'queued' END AS status, count(*) AS rows FROM t GROUP BY 1, 2")
_add("reconcile", ("transaction_id", "engagement_id"), lambda df: quality.reconcile(df.groupBy("engagement_id").agg(F.count(F.lit(1)).alias("rows"), F.lit(0).alias("duplicate_rows"), F.count(F.lit(1)).alias("new_rows")), df), " SELECT count(*)::BIGINT AS uploaded, 0::BIGINT AS duplicates, count(*)::BIGINT AS new_rows, count(*) AS in_facts, true AS agrees FROM t")
_add("savings_by_lever", insight._EVERY, lambda df: recommend.by_lever(insight._allocated(df)), f", {insight._ALLOCATED}, lv AS (SELECT *, CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in recommend.LEVERS.items()) + " END AS lever FROM z) SELECT lever, round(sum(estimated_impact), 2) AS impact, count(*) AS count FROM lv GROUP BY 1")
_add("supplier_months", ("canonical_supplier_name", "invoice_date", *SPEND), lambda df: presentation.trends(df, "canonical_supplier_name", ("Supplier#000000001", "Supplier#000000002")), f" SELECT canonical_supplier_name, {spend._MONTH} AS invoice_month, {spend._SUM} AS total_spend FROM a WHERE canonical_supplier_name IN ('Supplier#000000001', 'Supplier#000000002') AND invoice_date IS NOT NULL GROUP BY 1, 2")
_add("model_answers", ("raw_line_description",), lambda df: df.where("raw_line_description is not null").select(text.without_code_fence(F.concat(F.lit("```json\n{\"a\": \""), "raw_line_description", F.lit("\"}\n```"))).alias("answer")).distinct(), " SELECT DISTINCT '{\"a\": \"' || raw_line_description || '\"}' AS answer FROM t WHERE raw_line_description IS NOT NULL")
_add("compact_spend", ("category_l1", *SPEND), lambda df: cube.by(df, ["category_l1"]).select("category_l1", numbers.compact(F.col("total_spend"), "$").alias("label")), f", g AS (SELECT category_l1, {spend._SUM} AS x FROM a GROUP BY 1) SELECT category_l1, '$' || CASE WHEN abs(x) >= 1e9 THEN printf('%.1fB', x / 1e9) WHEN abs(x) >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN abs(x) >= 1e3 THEN printf('%.1fK', x / 1e3) ELSE printf('%.0f', x) END AS label FROM g")

# names with legal forms and abbreviations
_SHORT = "CASE i WHEN 'HR' THEN 'human resources' WHEN 'IT' THEN 'information technology' WHEN 'OPERATIONS' THEN 'operations' ELSE lower(i) END"


def _made_up_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.export(spark, operate.order_numbers(spark, sf_dir), operate.SEED).select(F.col("VENDOR_NAME").alias("raw_supplier_name"), F.col("VENDOR_NUM").alias("raw_supplier_id"))
    return suppliers.distinct_names(rows).select("raw_supplier_name", "normalised_name", "group_size")


book.add("names_with_forms", _made_up_names, f"""
WITH e AS ({operate.book.sql['synthetic_export']}), n AS (SELECT DISTINCT VENDOR_NAME AS raw_supplier_name, regexp_extract(VENDOR_NAME, '^INTERCOMPANY - (.*)$', 1) AS i FROM e), d AS (
  SELECT raw_supplier_name, CASE WHEN i <> '' THEN 'intercompany ' || {_SHORT} ELSE 'supplier ' || regexp_extract(raw_supplier_name, '[0-9]+') END AS normalised_name FROM n)
SELECT *, count(*) OVER (PARTITION BY normalised_name) AS group_size FROM d""")


# one run from an export to savings
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = export(spark, sf_dir)
    empty = lambda fields: spark.createDataFrame([], fields)
    directory = new_folder(spark, "run")
    rates = synthetic.fx_series(spark, operate.FX_RANGES, seed=operate.SEED, listed_months=operate.order_months(spark, sf_dir))
    done, _ = runs.whole(raw, rates, empty(reference.SEED_SCHEMA), empty(schema.OVERRIDE_SCHEMA), directory, "E1")
    views = files.read_views(spark, directory, "transactions")["transactions"]
    keys = ["category_l1", "category_l2"]
    return done.facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("canonical_supplier_id").alias("suppliers")).join(views.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_cube")), keys)


book.add("end_to_end", end_to_end, f"""
WITH {TRANSACTIONS_SQL}, {EXPORT_SQL}, w(i, l1, l2, c) AS (VALUES {resolve._RULES}), e AS (SELECT DISTINCT * FROM x), r AS (SELECT VENDOR_NAME, {resolve._WORDS} AS i FROM (SELECT VENDOR_NAME, lower(LINE_DESC || ' ' || LINE_DESC) AS d FROM e))
SELECT l1 AS category_l1, l2 AS category_l2, count(*) AS facts, count(DISTINCT nullif(VENDOR_NAME, '')) AS suppliers, count(*) AS in_cube FROM r JOIN w USING (i) GROUP BY 1, 2""")


# what pages show of a selection, in order
_PROMO = "category_l1 = 'PROMO'"
_NUMBER = "row_number() OVER (ORDER BY total_spend DESC, {by})::INT AS rank"
_add("category_suppliers", ("category_l1", "canonical_supplier_name", *SPEND), lambda df: presentation.breakdown(df, "category_l1", ("PROMO",), "canonical_supplier_name", 10), f"""
, g AS (SELECT canonical_supplier_name, {spend._SUM} AS total_spend FROM a WHERE {_PROMO} GROUP BY 1), r AS (SELECT *, {_NUMBER.format(by="canonical_supplier_name")} FROM g WHERE canonical_supplier_name IS NOT NULL) SELECT * FROM r WHERE rank <= 10""")
_add("supplier_units", ("canonical_supplier_name", "business_unit", *SPEND), lambda df: presentation.breakdown(df, "canonical_supplier_name", ("Supplier#000000001", "Supplier#000000002"), "business_unit"), f"""
, g AS (SELECT business_unit, {spend._SUM} AS total_spend FROM a WHERE canonical_supplier_name IN ('Supplier#000000001', 'Supplier#000000002') GROUP BY 1) SELECT *, {_NUMBER.format(by="business_unit")} FROM g WHERE business_unit IS NOT NULL""")


def _ordered(df: DataFrame, *order) -> DataFrame:
    """A short result with its place in the order it should have."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


_add("oldest_rows", ("transaction_id", "ingested_at", "payment_terms_days"), lambda df: _ordered(filters.oldest(df.select("transaction_id", F.when(F.col("payment_terms_days") != 30, F.col("ingested_at")).alias("ingested_at")), "ingested_at", 25, "transaction_id"), F.monotonically_increasing_id()), """
, o AS (SELECT transaction_id, CASE WHEN payment_terms_days <> 30 THEN ingested_at END AS ingested_at FROM t), r AS (SELECT *, row_number() OVER (ORDER BY ingested_at NULLS LAST, transaction_id)::INT AS place FROM o) SELECT * FROM r WHERE place <= 25""")
book.add("review_queue_page", lambda spark, sf_dir: _ordered(suppliers.review_queue(_log(spark, sf_dir), _master(spark, sf_dir), transactions(spark, sf_dir, "raw_supplier_name", "base_amount")).select("raw_supplier_name", "confidence", "spend").limit(20), F.monotonically_increasing_id()), f"""
WITH {TRANSACTIONS_SQL}, {_LOG_SQL}, v AS (SELECT raw_supplier_name, sum(base_amount)::DOUBLE AS spend FROM t GROUP BY 1), q AS (SELECT l.raw_supplier_name, confidence, coalesce(spend, 0.0) AS spend FROM l LEFT JOIN v ON v.raw_supplier_name = l.raw_supplier_name WHERE review_status = 'PENDING'),
r AS (SELECT *, row_number() OVER (ORDER BY confidence, spend DESC, raw_supplier_name)::INT AS place FROM q) SELECT * FROM r WHERE place <= 20""")
_add("stored_score", spend._CHECKED, lambda df: quality.stored_score(quality.diagnose(df)), f"{spend._BY_WORDS} SELECT round_even(avg(CASE WHEN status IN ('GREEN', 'INFO') THEN 100 WHEN status IN ('AMBER', 'WARN') THEN 50 ELSE 0 END), 0)::INT AS score FROM d")
_add("first_names", ("transaction_id", "raw_supplier_name", "raw_supplier_id"), lambda df: suppliers.distinct_names(df.withColumn("raw_supplier_id", F.concat("raw_supplier_id", F.lit("/"), "transaction_id")), "transaction_id").select("raw_supplier_name", "raw_supplier_id", "seen", "group_size"), " SELECT raw_supplier_name, arg_min(raw_supplier_id || '/' || transaction_id, transaction_id) AS raw_supplier_id, min(transaction_id) AS seen, 1::BIGINT AS group_size FROM t WHERE raw_supplier_name IS NOT NULL GROUP BY 1")
book.add("override_match_master", lambda spark, sf_dir: changes.with_supplier(changes.with_supplier(_master(spark, sf_dir), "c99x", "Other Pty Ltd"), "c1", "Not new").select("canonical_supplier_id", "canonical_name", "normalised_name"), f"WITH {_MASTER_SQL} SELECT canonical_supplier_id, canonical_name, NULL::VARCHAR AS normalised_name FROM m UNION ALL SELECT 'c99x', 'Other Pty Ltd', 'other'")


def _stored_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in folders: rows of one tenant with terms of 30 days are processed, then read back."""
    path, fields = new_folder(spark, "facts"), "transaction_id string, engagement_id string, payment_terms_days int, status string"
    df = transactions(spark, sf_dir, "transaction_id", "engagement_id", "payment_terms_days").withColumns({"payment_terms_days": F.col("payment_terms_days").cast("int"), "status": F.lit("queued")})
    parted.create(df, path, fields, "transaction_id")
    news = parted.read(spark, path, fields, tenants=["E0"]).where("payment_terms_days = 30").select("transaction_id", "engagement_id")
    parted.change(spark, path, fields, "transaction_id", news, lambda rows, ids: changes.set_status(rows, ids, "transaction_id", "processed"))
    return _count(parted.read(spark, path, fields), "engagement_id", "status")


book.add("stored_change", _stored_change, f"WITH {TRANSACTIONS_SQL} SELECT engagement_id, CASE WHEN engagement_id = 'E0' AND payment_terms_days = 30 THEN 'processed' ELSE 'queued' END AS status, count(*) AS rows FROM t GROUP BY 1, 2")
