"""Queries over models as plug-ins, with stand-ins whose answers SQL can tell."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.operators import categorise, models
from outlay.plans.book import Book

book = Book()


def sorter():
    """A model that goes by the first word, is surer of longer texts and has nothing to say about bolts; a code fence around its answers."""

    def ask(items: list[dict]) -> str:
        found = [
            {"transaction_id": i["transaction_id"], "internal_category_l1": i["description"].split(" ")[0].upper(), "internal_category_l2": i["supplier_name"] or None, "confidence": len(i["description"]) / 16, "reasoning": "by the first word"}
            for i in items
            if "bolt" not in i["description"]
        ]
        return f"```json\n{json.dumps(found)}\n```"

    return ask


def owner():
    """A model that names a parent after the last digit of a supplier's number."""
    return lambda items: json.dumps([{"supplier_name": i["supplier_name"], "parent_company_name": f"Group {i['supplier_name'][-1]}", "confidence": int(i["supplier_name"][-1]) / 10} for i in items])


def measure():
    """An encoder: length, and how often each of two letters occurs."""
    return lambda texts: [[float(len(t)), float(t.count("e")), float(t.count("a"))] for t in texts]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("string").alias("transaction_id"), F.col("p_name").alias("raw_line_description"), F.col("p_brand").alias("canonical_supplier_name"), F.lit("").alias("gl_account"))


_ASKED = ("transaction_id", "internal_category_l1", "internal_category_l2", "confidence", "method", "reasoning")
book.add("model_categories", lambda spark, sf_dir: models.classify(_parts(spark, sf_dir), sorter).select(*_ASKED), f"""
SELECT p_partkey::VARCHAR AS transaction_id, CASE WHEN NOT b THEN upper(split_part(p_name, ' ', 1)) END AS internal_category_l1, CASE WHEN NOT b THEN p_brand END AS internal_category_l2,
  CASE WHEN b THEN 0.0 ELSE least(length(p_name) / 16.0, {models.CATEGORY_CAP}) END::DOUBLE AS confidence, 'LLM' AS method, CASE WHEN b THEN 'no answer for this row' ELSE 'by the first word' END AS reasoning FROM (SELECT *, contains(p_name, 'bolt') AS b FROM part)""")
book.add("model_dry_run", lambda spark, sf_dir: models.classify(_parts(spark, sf_dir)).select(*_ASKED), "SELECT p_partkey::VARCHAR AS transaction_id, NULL::VARCHAR AS internal_category_l1, NULL::VARCHAR AS internal_category_l2, 0.0::DOUBLE AS confidence, 'DRY_RUN' AS method, NULL::VARCHAR AS reasoning FROM part")


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over the parts' names: keyword rules first, the model for what they leave."""
    from outlay import reference, schema

    empty = lambda fields: spark.createDataFrame([], fields)
    said = F.when(F.col("transaction_id").cast("int") % 5 == 0, F.concat("raw_line_description", F.lit(" courier"))).otherwise(F.col("raw_line_description"))
    rows = _parts(spark, sf_dir).withColumns({"raw_line_description": said, "canonical_supplier_id": F.lit(None).cast("string")})
    out = categorise.categorise(rows, empty(reference.SEED_SCHEMA), empty(schema.OVERRIDE_SCHEMA), model=models.category_model(sorter))
    return out.groupBy("category_l1", "category_method", "categorisation_status", "ai_classification_flag").agg(F.count(F.lit(1)).alias("rows"))


book.add("model_in_cascade", _cascade, f"""
WITH p AS (SELECT p_partkey % 5 = 0 AS k, contains(p_name, 'bolt') AS b, split_part(p_name, ' ', 1) AS w, length(p_name) / 16.0 AS c FROM part)
SELECT CASE WHEN k THEN 'Logistics' WHEN NOT b THEN upper(w) END AS category_l1, CASE WHEN k THEN 'KEYWORD' WHEN NOT b THEN 'LLM' END AS category_method,
  CASE WHEN k OR (NOT b AND least(c, {models.CATEGORY_CAP}) >= 0.6) THEN 'categorised' ELSE 'review_required' END AS categorisation_status, (NOT k AND NOT b)::INT AS ai_classification_flag, count(*) AS rows FROM p GROUP BY ALL""")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts' names, those of even parts from a store: of each whether it was new, and its vector as text."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    store = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("id")).distinct().withColumn("vector", F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0)))
    found, grown = models.encode(part.select(F.col("p_name").alias("text")), store, measure)
    return found.join(grown.select(F.col("id").alias("text"), F.col("vector").alias("kept")), "text").select("text", F.array_join("vector", ",").alias("vector"), (F.col("vector") == F.col("kept")).alias("is_stored"))


book.add("encoded_names", _encoded, """
WITH s AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT p_name AS t, s.p_name IS NOT NULL AS old FROM part LEFT JOIN s USING (p_name))
SELECT t AS text, CASE WHEN old THEN '-1.0,0.0,0.0' ELSE length(t)::DOUBLE || ',' || (length(t) - length(replace(t, 'e', '')))::DOUBLE || ',' || (length(t) - length(replace(t, 'a', '')))::DOUBLE END AS vector, true AS is_stored FROM n""")
book.add("model_parents", lambda spark, sf_dir: models.parents(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("supplier_name")), owner).select("supplier_name", "parent_company_name", "confidence", "method"), f"SELECT DISTINCT s_name AS supplier_name, 'Group ' || right(s_name, 1) AS parent_company_name, least(right(s_name, 1)::INT / 10, {models.PARENT_CAP})::DOUBLE AS confidence, 'LLM' AS method FROM supplier")
