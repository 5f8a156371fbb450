"""Data quality: nine checks, two ways to band them, three scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions import numbers, text
from outlay.operators.filters import PROBLEMS

# Fixed values: (check, what its percentage is of, first limit, second limit); the sixth is for information.
CHECKS = (
    ("missing_supplier_name", "rows", 1.0, 5.0),
    ("uncategorised_spend", "spend", 5.0, 15.0),
    ("unresolved_suppliers", "names", 10.0, 25.0),
    ("missing_payment_terms", "spend", 10.0, 30.0),
    ("duplicate_invoice_risk", "rows", 0.5, 2.0),
    ("negative_reversal_lines", "rows", 3.0, 8.0),
    ("weak_descriptions", "rows", 15.0, 30.0),
    ("missing_contract_linkage", "spend", 30.0, 60.0),
    ("missing_bu_cost_centre", "rows", 5.0, 15.0),
)
INFORMATION = "negative_reversal_lines"


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that share invoice number and amount (both known), with how many share them."""
    # counted first, so that a key with very many rows is summed before it is sent
    keys = ["invoice_number", "base_amount"]
    several = df.where("invoice_number is not null and base_amount is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    return df.join(several, keys)


def invoice_counts(df: DataFrame, *more: Column) -> DataFrame:
    """Rows of each invoice number and amount, also of those without a number: a filter here would be moved to the tables and keep this pass from sharing its shuffled rows with the others."""
    return df.groupBy("invoice_number", "base_amount").agg(F.count(F.lit(1)).alias("n"), *more)


def _duplicates(counts: DataFrame, null_amounts: bool) -> DataFrame:
    several = (F.col("n") > 1) & F.col("invoice_number").isNotNull()
    if not null_amounts:
        several &= F.col("base_amount").isNotNull()
    return counts.agg(F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("duplicate_invoice_risk"))


def _names(df: DataFrame, any_null: bool) -> DataFrame:
    """Names in all, and those without a supplier: none of its rows has one, or (``any_null``) any of its rows lacks one."""
    rows = df.where("raw_supplier_name is not null").groupBy("raw_supplier_name")
    # truth values are added up by hashing; the largest of texts would sort all rows
    lacks = F.col("canonical_supplier_id").isNull()
    rows = rows.agg((F.bool_or(lacks) if any_null else F.bool_and(lacks)).alias("missing"))
    return rows.agg(F.count(F.lit(1)).alias("names"), F.count_if("missing").alias("unresolved_suppliers"))


def _conditions(by_words: bool) -> dict[str, tuple[str, Column]]:
    """What each check counts or sums over the rows: its kind and which rows; all of them for ``rows`` and ``spend``."""
    weak = text.weak_description_words(F.col("raw_line_description")) if by_words else text.weak_description_chars(F.col("raw_line_description"))
    out = {"rows": ("rows", F.lit(True)), "spend": ("spend", F.lit(True))}
    for check, of, *_ in CHECKS:
        if check not in ("unresolved_suppliers", "duplicate_invoice_risk"):
            out[check] = of, weak if check == "weak_descriptions" else PROBLEMS[check]()
    return out


def values(by_words: bool = True) -> dict[str, Column]:
    """What each check counts or sums in one pass over the rows."""
    return {k: numbers.total(F.when(c, F.abs("base_amount"))) if of == "spend" else F.count_if(c).cast("double") for k, (of, c) in _conditions(by_words).items()}


def diagnose(df: DataFrame, by_words: bool = True) -> DataFrame:
    """Nine rows: ``check``, ``value``, ``pct``, ``status``.

    ``by_words``: descriptions under five words are weak, a name is unresolved if none of its rows has a
    supplier, and duplicates need an amount. Otherwise: under 20 characters, any row without one, and
    null amounts are equal. No rows give zeros. Two passes: by name, whose sums are exact and added up again, and by invoice and amount.
    """
    wanted, lacks = _conditions(by_words), F.col("canonical_supplier_id").isNull()
    parts = {k: F.sum(F.when(c, F.abs("base_amount")).cast("decimal(18,2)")) if of == "spend" else F.count_if(c) for k, (of, c) in wanted.items()}
    named = df.groupBy("raw_supplier_name").agg(*[v.alias(k) for k, v in parts.items()], (F.bool_and(lacks) if by_words else F.bool_or(lacks)).alias("missing"))
    known = F.col("raw_supplier_name").isNotNull()
    one = named.agg(*[numbers.money(F.sum(k)).alias(k) for k in wanted], F.count_if(known).alias("names"), F.count_if(known & F.col("missing")).alias("unresolved_suppliers"))
    return _banded(one.join(F.broadcast(_duplicates(invoice_counts(df), not by_words))))


def _banded(one: DataFrame) -> DataFrame:
    """From the row of all values to the nine rows."""
    result = []
    for check, of, first, second in CHECKS:
        pct = F.round(numbers.ratio(F.col(check), F.col(of)) * 100, 2)
        state = numbers.info_status(pct, first, second) if check == INFORMATION else numbers.status(pct, first, second)
        result.append(F.struct(F.lit(check).alias("check"), F.round(F.col(check).cast("double"), 2).alias("value"), pct.alias("pct"), state.alias("status")))
    return one.select(F.inline(F.array(*result)))


def scorecard(df: DataFrame, by_words: bool = True) -> DataFrame:
    return scorecard_of(diagnose(df, by_words))


def scorecard_of(checks: DataFrame) -> DataFrame:
    """One row: the mean of 100 for green and information, 50 for amber and warnings, 0 for red and alerts; and the checks as text."""
    state = F.col("status")
    points = F.when(state.isin("GREEN", "INFO"), 100.0).when(state.isin("AMBER", "WARN"), 50.0).otherwise(0.0)
    lines = F.array_sort(F.collect_list(F.format_string("%s: %.2f%% %s", "check", "pct", "status")))
    return checks.agg(F.round(F.avg(points), 1).alias("overall_score"), F.array_join(lines, "\n").alias("scorecard"))


def score_for_kpis(df: DataFrame) -> DataFrame:
    """One row: the mean of 100, 60 and 20 for green, amber and red; other states count 0."""
    return score_of(diagnose(df))


def score_of(checks: DataFrame) -> DataFrame:
    state = F.col("status")
    points = F.when(state == "GREEN", 100.0).when(state == "AMBER", 60.0).when(state == "RED", 20.0).otherwise(0.0)
    return checks.agg(F.round(F.avg(points), 1).alias("data_quality_score"))


def stored_score(checks: DataFrame) -> DataFrame:
    """One row: the score of checks as they were stored, a whole number, ties to the even one; 0 without checks, other states count 0."""
    state = F.col("status")
    points = F.when(state.isin("GREEN", "INFO"), 100).when(state.isin("AMBER", "WARN"), 50).otherwise(0)
    return checks.agg(F.coalesce(numbers.half_even(F.avg(points), 0), F.lit(0.0)).cast("int").alias("score"))


def by_severity(checks: DataFrame) -> DataFrame:
    rank = F.when(F.col("status").isin("RED", "ALERT"), 0).when(F.col("status").isin("AMBER", "WARN"), 1).otherwise(2)
    return checks.orderBy(rank, "check")


def occurrences(df: DataFrame) -> DataFrame:
    """All rows with the number of rows that share their invoice number and amount (0 where one is missing)."""
    keys = ["invoice_number", "base_amount"]
    # counted first: rows that miss a key, however many, aren't sent to one task
    known = df.where("invoice_number is not null and base_amount is not null")
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    rest = df.where("invoice_number is null or base_amount is null").withColumn("occurrences", F.lit(0).cast("long"))
    return known.join(counts, keys).select(*df.columns, "occurrences").unionByName(rest)


def reconcile(landed: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: what was uploaded, how much of it was new, and what the facts hold."""
    up = landed.agg(F.sum("rows").alias("uploaded"), F.sum("duplicate_rows").alias("duplicates"), F.sum("new_rows").alias("new_rows"))
    return up.join(F.broadcast(facts.agg(F.count(F.lit(1)).alias("in_facts")))).withColumn("agrees", F.col("new_rows") == F.col("in_facts"))
