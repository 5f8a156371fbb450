"""Queries over cleaning, currency, suppliers and categories, with their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay import reference
from outlay.config import DEFAULT
from outlay.functions import dates, numbers
from outlay.operators import categorise, ingest, suppliers, vectors
from outlay.plans.book import Book
from outlay.plans.fuzzy_sql import scored
from outlay.schema import OVERRIDE_SCHEMA
from outlay.sources.scratch import new_folder
from outlay.sources.warehouse import TRANSACTIONS_SQL, transactions

book = Book()


def _add(name: str, columns: tuple[str, ...], operator, sql: str) -> None:
    book.add(name, lambda spark, sf_dir: operator(transactions(spark, sf_dir, *columns)), f"WITH {TRANSACTIONS_SQL}{sql}")


# cleaning
def clean_flags(df: DataFrame) -> DataFrame:
    internal, tax = F.col("is_intercompany") == 1, F.col("is_tax_line")
    raw = df.select(
        "invoice_number", "gl_account", "raw_payment_terms", F.col("base_amount").cast("string").alias("original_amount"),
        F.when(internal, F.concat(F.lit("  Intercompany - "), "raw_supplier_name")).otherwise(F.col("raw_supplier_name")).alias("raw_supplier_name"),
        F.when(tax == 1, "GST adjustment").when(tax == 0, F.concat(F.lit("Freight "), "raw_line_description")).otherwise("N/A").alias("raw_line_description"),
    )
    keys = ["document_type", "payment_terms_days", "is_credit_note", "is_intercompany", "is_tax_line", "is_freight_line"]
    return ingest.clean(raw).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count("raw_line_description").alias("described"))


_any = lambda c, words: "coalesce(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ", false)::INT"
_add("clean_flags", ("invoice_number", "gl_account", "raw_payment_terms", "base_amount", "raw_supplier_name", "raw_line_description", "is_intercompany", "is_tax_line"), clean_flags, f""", r AS (
  SELECT base_amount < 0 OR starts_with(invoice_number, 'CN-') AS credit, payment_terms_days, CASE WHEN is_intercompany = 1 THEN 'INTERCOMPANY - ' || upper(raw_supplier_name) ELSE upper(raw_supplier_name) END AS s,
    lower(CASE WHEN is_tax_line = 1 THEN 'GST adjustment' WHEN is_tax_line = 0 THEN 'Freight ' || raw_line_description END) AS d FROM t)
SELECT CASE WHEN credit THEN 'CREDIT_NOTE' ELSE 'INVOICE' END AS document_type, payment_terms_days, credit::INT AS is_credit_note, {_any('s', reference.INTERCOMPANY)} AS is_intercompany,
  {_any('d', reference.TAX)} AS is_tax_line, {_any('d', reference.FREIGHT)} AS is_freight_line, count(*) AS rows, count(d) AS described FROM r GROUP BY ALL""")


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.lit("N/A")
    for k, pattern in enumerate(("d/M/yyyy", "yyyy-MM-dd", "dd-MMM-yyyy", "MMMM d yyyy")):
        text = F.when(kind == k, F.date_format(d, pattern)).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", dates.parse_date(text).alias("invoice_date"))


book.add("parse_dates", parse_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS invoice_date FROM orders")

# currency: a short table of rates with gaps
RATES = [(m, c, "AUD", r) for m, rates in {"1995-01": (1.3, 1.6, 2.1), "1996-07": (1.27, 1.655, 1.95), "1998-03": (1.495, 1.62, 2.515)}.items() for c, r in zip(("USD", "EUR", "GBP"), rates, strict=True)]


def fx(df: DataFrame) -> DataFrame:
    rates = df.sparkSession.createDataFrame(RATES, reference.FX_SCHEMA)
    out = ingest.convert(df.withColumnRenamed("base_amount", "original_amount"), rates)
    return out.groupBy("original_currency", "fx_rate", "fx_warning").agg(F.count(F.lit(1)).alias("rows"), numbers.total(F.col("base_amount")).alias("total_spend"))


_add("fx_exact_and_nearest", ("original_currency", "invoice_date", "base_amount"), fx, f""", f(ym, c, r) AS (VALUES {', '.join(f"('{m}', '{c}', {r}::DOUBLE)" for m, c, _, r in RATES)}),
f2 AS (SELECT c, substr(ym, 1, 4)::INT * 12 + substr(ym, 6, 2)::INT AS m, r FROM f), need AS (SELECT DISTINCT original_currency AS c, year(invoice_date) * 12 + month(invoice_date) AS m FROM t),
near AS (SELECT need.c, need.m, f2.r, f2.m <> need.m AS estimated, row_number() OVER (PARTITION BY need.c, need.m ORDER BY abs(f2.m - need.m), f2.m) AS k FROM need JOIN f2 ON f2.c = need.c),
j AS (SELECT t.original_currency, base_amount, CASE WHEN original_currency = 'AUD' THEN 1.0::DOUBLE ELSE r END AS fx_rate, CASE WHEN original_currency = 'AUD' THEN NULL WHEN r IS NULL THEN 'UNKNOWN_CURRENCY_PAIR' WHEN estimated THEN 'RATE_ESTIMATE' END AS fx_warning
  FROM t LEFT JOIN near ON near.c = original_currency AND near.m = year(invoice_date) * 12 + month(invoice_date) AND k = 1)
SELECT original_currency, fx_rate, fx_warning, count(*) AS rows, sum(coalesce(round(base_amount * fx_rate::DECIMAL(18,6), 2), base_amount)::DECIMAL(18,2))::DOUBLE AS total_spend FROM j GROUP BY 1, 2, 3""")

# suppliers
_NAMES = ("raw_supplier_name", "raw_supplier_id")
_NORMALISED = "trim(regexp_replace(lower(raw_supplier_name), '[^a-z0-9_]+', ' ', 'g'))"
_add("canonical_ids", _NAMES, lambda df: suppliers.build_master(suppliers.distinct_names(df)).select("canonical_supplier_id", "canonical_name", "normalised_name"), f" SELECT DISTINCT substr(sha256({_NORMALISED}), 1, 12) AS canonical_supplier_id, raw_supplier_name AS canonical_name, {_NORMALISED} AS normalised_name FROM t WHERE raw_supplier_name IS NOT NULL")
_add("vendor_id_match", _NAMES, lambda df: suppliers.vendor_ids(suppliers.build_master(suppliers.distinct_names(df))), f" SELECT DISTINCT raw_supplier_id, substr(sha256({_NORMALISED}), 1, 12) AS vendor_match FROM t WHERE raw_supplier_name IS NOT NULL")


def harmonised(df: DataFrame) -> DataFrame:
    """Names against a master that knows every other supplier: methods and confidences."""
    master = suppliers.build_master(suppliers.distinct_names(df))
    known = master.where(F.conv(F.substring("canonical_supplier_id", 1, 1), 16, 10).cast("int") % 2 == 0)
    _, log = suppliers.harmonise(df, known)
    return log.select("raw_supplier_name", "match_method", "confidence", "review_status")


_AUTO, _REVIEW = DEFAULT.fuzzy_auto, DEFAULT.fuzzy_review
book.add("harmonise_suppliers", lambda spark, sf_dir: harmonised(transactions(spark, sf_dir, *_NAMES)), f"""
WITH {TRANSACTIONS_SQL}, n AS (SELECT DISTINCT raw_supplier_name, {_NORMALISED} AS name FROM t WHERE raw_supplier_name IS NOT NULL), k AS (SELECT *, ('0x' || substr(sha256(name), 1, 1))::INT % 2 = 0 AS known FROM n),
pairs AS (SELECT a.name, b.name AS candidate FROM k a, k b WHERE NOT a.known AND b.known), {scored('pairs')}, best AS (SELECT name, max(score) AS score FROM scored GROUP BY 1), m AS (
  SELECT raw_supplier_name, known, score, CASE WHEN known THEN 'EXACT_NORMALISED_NAME' WHEN score * 100 >= {_AUTO} THEN 'FUZZY_AUTO' WHEN score * 100 >= {_REVIEW} THEN 'FUZZY_REVIEW' ELSE 'NEW_CANONICAL' END AS match_method FROM k LEFT JOIN best USING (name)),
c AS (SELECT raw_supplier_name, match_method, CASE match_method WHEN 'EXACT_NORMALISED_NAME' THEN 0.95::DOUBLE WHEN 'FUZZY_AUTO' THEN score * 0.95::DOUBLE WHEN 'FUZZY_REVIEW' THEN score * 0.85::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM m)
SELECT raw_supplier_name, match_method, round(confidence, 6) AS confidence, CASE WHEN confidence < {DEFAULT.supplier_review_below} THEN 'PENDING' ELSE 'APPROVED' END AS review_status FROM c""")


def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the parts' names against their types."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("normalised_name")).distinct()
    master = part.select(F.lower("p_type").alias("normalised_name")).distinct().withColumn("canonical_supplier_id", F.col("normalised_name"))
    return suppliers.match_fuzzy(names, master).select("normalised_name", "fuzzy_id", F.round("fuzzy_score", 6).alias("score"), F.col("fuzzy.method").alias("method"))


book.add("fuzzy_match", fuzzy, f"""
WITH n AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS name FROM part), k AS (SELECT DISTINCT lower(p_type) AS candidate FROM part), pairs AS (SELECT name, candidate FROM n, k), {scored('pairs')},
best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS i FROM scored)
SELECT name AS normalised_name, candidate AS fuzzy_id, round(score, 6) AS score, CASE WHEN score * 100 >= {_AUTO} THEN 'FUZZY_AUTO' WHEN score * 100 >= {_REVIEW} THEN 'FUZZY_REVIEW' ELSE 'FUZZY_REJECT' END AS method FROM best WHERE i = 1""")


def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; a word and a type that a part has both are corroborated by its size."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("normalised_name")).distinct()
    master = part.select(F.lower("p_type").alias("normalised_name")).distinct().withColumn("canonical_supplier_id", F.col("normalised_name"))
    size = F.col("p_size")
    points = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("normalised_name"), F.lower("p_type").alias("canonical_supplier_id"), suppliers.corroboration(size % 2 == 0, size % 3 == 0, size % 5 == 0).alias("boost"))
    found = suppliers.match_fuzzy(names, master, boosts=points, settings=_EASY)
    return found.select("normalised_name", "fuzzy_id", F.round("fuzzy_score", 6).alias("score"), F.col("fuzzy.method").alias("method"), F.round("fuzzy.confidence", 6).alias("confidence"))


#: Thresholds that these short words come near.
_EASY = DEFAULT.overlaid({"fuzzy_auto": 75.0, "fuzzy_review": 60.0})
_POINTS = f"CASE WHEN p_size % 2 = 0 THEN {DEFAULT.same_city} ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN {DEFAULT.same_postcode} ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN {DEFAULT.same_abn} ELSE 0 END"
book.add("fuzzy_boosted", boosted, f"""
WITH w AS (SELECT unnest(string_split(lower(p_name), ' ')) AS name, lower(p_type) AS candidate, {_POINTS} AS boost FROM part), n AS (SELECT DISTINCT name FROM w), k AS (SELECT DISTINCT candidate FROM w), pairs AS (SELECT name, candidate FROM n, k), {scored('pairs')},
best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS i FROM scored), b AS (SELECT name, candidate, max(boost) AS boost FROM w GROUP BY 1, 2),
p AS (SELECT best.name, best.candidate, score, score * 100 + coalesce(boost, 0) AS points FROM best LEFT JOIN b ON b.name = best.name AND b.candidate = best.candidate WHERE i = 1)
SELECT name AS normalised_name, candidate AS fuzzy_id, round(score, 6) AS score, CASE WHEN points >= {_EASY.fuzzy_auto} THEN 'FUZZY_AUTO' WHEN points >= {_EASY.fuzzy_review} THEN 'FUZZY_REVIEW' ELSE 'FUZZY_REJECT' END AS method,
  round(CASE WHEN points >= {_EASY.fuzzy_auto} THEN score * 0.95::DOUBLE WHEN points >= {_EASY.fuzzy_review} THEN score * 0.85::DOUBLE ELSE score END, 6) AS confidence FROM p""")


def nearest(top: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
        labels = table.groupBy(F.col("label").alias("id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
        found = vectors.match_vectors(table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), labels, top)
        return found.withColumn("similarity", F.round("similarity", 6))

    return run


for _top in (1, 2):
    book.add(f"cosine_top{_top}", nearest(_top), f"""
WITH c AS (SELECT label AS candidate_id, arg_min(embedding, vec_id) AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1), s AS (
  SELECT vec_id AS query_id, candidate_id, list_inner_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) + 1e-10) AS similarity
  FROM embeddings, c WHERE embedding IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id)::INT AS rank FROM s)
SELECT query_id, rank, candidate_id, round(similarity, 6) AS similarity FROM r WHERE rank <= {_top}""")

# categories
GL = [("6001", "Facilities", "Utilities"), ("06100", "IT", "Software"), ("6250", "Logistics", "Freight"), ("6400", "Finance", "Audit")]
BY_SUPPLIER = [("Supplier#000000002", "HR", "Training"), ("supplier#000000003", "Marketing", "Events")]
_ID = hashlib.sha256(b"supplier#000000001").hexdigest()[:12]
OVERRIDES = [(_ID, None, "First", 1), (None, "06100", "Second", 2), (_ID, None, "Third", 3), (None, "6400", "Fourth", 4)]
SAID = {14: " toner cartridge", 30: " courier", 45: " legal fees", 60: " cloud hosting"}


def _seeds(spark: SparkSession) -> DataFrame:
    """Written as a file and read as one, as users have them."""
    rows = [(k, v, l1, l2, None, "10", 0.9) for k, listed in (("GL", GL), ("SUPPLIER", BY_SUPPLIER)) for v, l1, l2 in listed]
    path = new_folder(spark, "seeds")
    spark.createDataFrame(rows, reference.SEED_SCHEMA.rpartition(",")[0]).coalesce(1).write.csv(path, header=True)
    return reference.seed_mappings(spark, path)


def _overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, gl, l1, None, None, None, "reviewer", "", n) for s, gl, l1, n in OVERRIDES], OVERRIDE_SCHEMA)


def _said(df: DataFrame) -> DataFrame:
    more = F.lit("")
    for days, words in SAID.items():
        more = F.when(F.col("payment_terms_days") == days, words).otherwise(more)
    return df.withColumn("raw_line_description", F.concat(F.coalesce("raw_line_description", F.lit("")), more))


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col(name)["l1"].alias("l1"), F.col(name)["l2"].alias("l2"), F.col(name)["confidence"].alias("confidence")).agg(F.count(F.lit(1)).alias("rows"))


_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)
_MORE = "CASE payment_terms_days " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SAID.items()) + " ELSE '' END"
_WORDS = "CASE " + " ".join(f"WHEN regexp_matches(d, '{p}') THEN {i}" for i, (p, *_) in enumerate(sorted(reference.KEYWORD_RULES, key=lambda r: -r[4]))) + " END"
_RULES = _values([(i, l1, l2, c) for i, (_, l1, l2, _, c) in enumerate(sorted(reference.KEYWORD_RULES, key=lambda r: -r[4]))])
_PARTS = f""", g(code, l1, l2) AS (VALUES {_values([(v.lstrip('0'), *r) for v, *r in GL])}), v(name, l1, l2) AS (VALUES {_values([(v.lower(), *r) for v, *r in BY_SUPPLIER])}), w(i, l1, l2, c) AS (VALUES {_RULES}),
o(sid, gl, l1, ord) AS (VALUES {_values([(s, gl and gl.lstrip('0'), l1, n) for s, gl, l1, n in OVERRIDES])}), x AS (
  SELECT canonical_supplier_id AS s, lower(canonical_supplier_name) AS n, ltrim(gl_account, '0') AS gl, {_WORDS} AS i, count(*) AS k FROM (SELECT *, lower(' ' || coalesce(raw_line_description, '') || {_MORE}) AS d FROM t) GROUP BY ALL),
y AS (SELECT *, (SELECT max(ord) FROM o WHERE o.sid = x.s OR o.gl = x.gl) AS ord FROM x)"""
_FACTS = ("transaction_id", "canonical_supplier_id", "canonical_supplier_name", "gl_account", "raw_line_description", "payment_terms_days")
_add("gl_category", _FACTS, lambda df: _counted(categorise.by_gl(df, _seeds(df.sparkSession)), "by_gl"), f"{_PARTS} SELECT g.l1, g.l2, CASE WHEN g.l1 IS NOT NULL THEN 0.9::DOUBLE END AS confidence, sum(k)::BIGINT AS rows FROM y LEFT JOIN g ON code = gl GROUP BY 1, 2, 3")
_add("supplier_category", _FACTS, lambda df: _counted(categorise.by_supplier(df, _seeds(df.sparkSession)), "by_supplier"), f"{_PARTS} SELECT v.l1, v.l2, CASE WHEN v.l1 IS NOT NULL THEN 0.9::DOUBLE END AS confidence, sum(k)::BIGINT AS rows FROM y LEFT JOIN v ON name = n GROUP BY 1, 2, 3")
_add("keyword_category", _FACTS, lambda df: _counted(categorise.by_keyword(_said(df)), "by_keyword"), f"{_PARTS} SELECT w.l1, w.l2, c::DOUBLE AS confidence, sum(k)::BIGINT AS rows FROM y LEFT JOIN w USING (i) GROUP BY 1, 2, 3")
_add("override_category", _FACTS, lambda df: _counted(categorise.by_override(df, _overrides(df.sparkSession)), "by_override"), f"{_PARTS} SELECT o.l1, NULL::VARCHAR AS l2, CASE WHEN o.l1 IS NOT NULL THEN 1.0::DOUBLE END AS confidence, sum(k)::BIGINT AS rows FROM y LEFT JOIN o USING (ord) GROUP BY 1, 3")


def cascade(df: DataFrame) -> DataFrame:
    out = categorise.categorise(_said(df), _seeds(df.sparkSession), _overrides(df.sparkSession))
    return out.groupBy("category_l1", "category_l2", "category_confidence", "category_method", "categorisation_status", "manual_override_flag").agg(F.count(F.lit(1)).alias("rows"))


_add("category_cascade", _FACTS, cascade, f"""{_PARTS}, z AS (SELECT k, CASE WHEN o.l1 IS NOT NULL THEN {{'a': o.l1, 'b': NULL, 'c': 1.0, 'm': 'MANUAL'}} WHEN g.l1 IS NOT NULL THEN {{'a': g.l1, 'b': g.l2, 'c': 0.9, 'm': 'GL_MAPPING'}}
  WHEN v.l1 IS NOT NULL THEN {{'a': v.l1, 'b': v.l2, 'c': 0.9, 'm': 'SUPPLIER_MAPPING'}} WHEN w.l1 IS NOT NULL THEN {{'a': w.l1, 'b': w.l2, 'c': w.c, 'm': 'KEYWORD'}} END AS f FROM y LEFT JOIN o USING (ord) LEFT JOIN g ON code = y.gl LEFT JOIN v ON name = n LEFT JOIN w USING (i))
SELECT f.a AS category_l1, f.b AS category_l2, f.c::DOUBLE AS category_confidence, f.m AS category_method, CASE WHEN f.c >= 0.6 THEN 'categorised' ELSE 'review_required' END AS categorisation_status, coalesce(f.m = 'MANUAL', false)::INT AS manual_override_flag, sum(k)::BIGINT AS rows FROM z GROUP BY ALL""")


# landing
def new_rows(df: DataFrame) -> DataFrame:
    """An upload of all rows, some of them twice, into a table that has a third of the tenants."""
    rows = df.withColumnRenamed("transaction_id", "source_row_hash")
    return ingest.insert_counts(rows.unionByName(rows.where("payment_terms_days = 30")), rows.where("engagement_id = 'E0'"))


_add("new_vs_duplicate_rows", ("engagement_id", "transaction_id", "payment_terms_days"), new_rows, """, n AS (SELECT count(*) AS new_rows FROM (SELECT DISTINCT engagement_id, transaction_id FROM t WHERE engagement_id <> 'E0'))
SELECT new_rows, (SELECT count(*) + count(*) FILTER (payment_terms_days = 30) FROM t) - new_rows AS duplicate_rows FROM n""")
