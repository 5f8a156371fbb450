"""Changes to stored tables as new versions of them: each returns the whole table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.config import DEFAULT, Settings
from outlay.functions import text
from outlay.operators.categorise import with_status
from outlay.operators.joins import look_up


def _replace(df: DataFrame, news: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``columns`` from ``news`` (one row per key) where it has the key; the rest stays."""
    marked = news.select(*key, F.struct(*columns).alias("_new"))
    rows = look_up(df, marked, key, common=False)
    new = {c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in columns}
    return rows.withColumns(new).select(*df.columns)


def set_status(df: DataFrame, ids: DataFrame, key: str, status: str, column: str = "status") -> DataFrame:
    """Rows whose key is in ``ids`` get ``status``."""
    return _replace(df, ids.select(key).distinct().withColumn(column, F.lit(status)), [key], [column])


def set_categories(df: DataFrame, found: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Categories by ``transaction_id``, and the flags that follow from them."""
    columns = ["category_l1", "category_l2", "category_l3", "unspsc_code", "category_confidence", "category_method"]
    changed = with_status(found.dropDuplicates(["transaction_id"]).select("transaction_id", *columns), settings)
    more = [c for c in ("categorisation_status", "ai_classification_flag", "manual_override_flag") if c in df.columns]
    return _replace(df, changed, ["transaction_id"], columns + more)


def set_segments(df: DataFrame, segments: DataFrame) -> DataFrame:
    """ABC segments by tenant and supplier; suppliers without one lose theirs."""
    key = ["engagement_id", "canonical_supplier_id"]
    return look_up(df.drop("abc_segment"), segments.select(*key, "abc_segment"), key)


def decide(log: DataFrame, raw_supplier_name: str, status: str) -> DataFrame:
    """A reviewer's decision on the match of one name."""
    return log.withColumn("review_status", F.when(F.col("raw_supplier_name") == raw_supplier_name, status).otherwise(F.col("review_status")))


def override_match(log: DataFrame, df: DataFrame, raw_supplier_name: str, supplier_id: str, supplier_name: str) -> tuple[DataFrame, DataFrame]:
    """(log, transactions): one name now belongs to the given supplier, surely."""
    hit = F.col("raw_supplier_name") == raw_supplier_name
    put = lambda c, v: F.when(hit, F.lit(v)).otherwise(F.col(c))
    log = log.withColumns({"canonical_supplier_id": put("canonical_supplier_id", supplier_id), "match_method": put("match_method", "MANUAL"), "confidence": put("confidence", 1.0), "review_status": put("review_status", "OVERRIDDEN")})
    return log, df.withColumns({"canonical_supplier_id": put("canonical_supplier_id", supplier_id), "canonical_supplier_name": put("canonical_supplier_name", supplier_name), "canonical_supplier_confidence": put("canonical_supplier_confidence", 1.0)})


def with_supplier(master: DataFrame, supplier_id: str, supplier_name: str) -> DataFrame:
    """The master with a supplier that a reviewer named, unless its id is there."""
    row = {"canonical_supplier_id": F.lit(supplier_id), "canonical_name": F.lit(supplier_name), "normalised_name": text.normalise_name(F.lit(supplier_name))}
    new = master.sparkSession.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in master.schema.fields])
    return master.unionByName(new.join(master.select("canonical_supplier_id"), "canonical_supplier_id", "left_anti").select(*master.columns))


def add_overrides(overrides: DataFrame, more: DataFrame) -> DataFrame:
    """Appends decisions that name a supplier or a ledger code; others are left out."""
    return overrides.unionByName(more.where("canonical_supplier_id is not null or gl_account is not null"))


def apply_feedback(overrides: DataFrame, feedback: DataFrame) -> DataFrame:
    """Reviewers' corrections in bulk (``canonical_supplier_id`` or ``gl_account``, ``l1``, and as far as there are ``l2``, ``l3``, ``unspsc_code``,
    ``reviewer``, ``reason``, ``override_order``) as decisions. Those that name neither supplier nor code are left out."""
    named = {"override_l1": "l1", "override_l2": "l2", "override_l3": "l3"}
    given = {f.name: F.col(n if (n := named.get(f.name, f.name)) in feedback.columns else "none").cast(f.dataType) for f in overrides.schema.fields}
    return add_overrides(overrides, feedback.withColumn("none", F.lit(None)).select(*[v.alias(k) for k, v in given.items()]))


def remove_rows(df: DataFrame, where: Column) -> DataFrame:
    """All rows but those for which the condition holds; where it is null, rows stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def insert_vectors(store: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """Appends vectors whose key isn't there yet."""
    return store.unionByName(more.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


def audit_all(log: DataFrame, entity: str, rows: DataFrame, actor: str) -> DataFrame:
    """Appends a line for each of ``rows`` (``entity_id``, ``action``, ``before``, ``after``) to an audit log."""
    lines = rows.select(F.lit(entity).alias("entity"), *[F.col(c).cast("string").alias(c) for c in ("entity_id", "action", "before", "after")], F.lit(actor).alias("actor"), F.current_timestamp().alias("at"))
    return log.unionByName(lines)


def audit(log: DataFrame, entity: str, entity_id: str, action: str, before: str | None, after: str | None, actor: str) -> DataFrame:
    """Appends one line to an audit log."""
    values = {"entity": entity, "entity_id": entity_id, "action": action, "before": before, "after": after, "actor": actor}
    row = log.sparkSession.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()], F.current_timestamp().alias("at"))
    return log.unionByName(row)
