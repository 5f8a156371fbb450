"""Windows over suppliers: ABC, tail, Pareto, concentration, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions import numbers
from outlay.operators.filters import addressable
from outlay.operators.joins import look_up
from outlay.operators.prefix import with_running


def supplier_spend(df: DataFrame, *tenant: str) -> DataFrame:
    """Addressable spend of each known supplier: from here on there is one row a supplier."""
    rows = addressable(df).where(F.col("canonical_supplier_id").isNotNull())
    return rows.groupBy(*tenant, "canonical_supplier_id").agg(F.sum(F.col("base_amount").cast("decimal(18,2)")).alias("spend"))


def _exact(c: Column) -> Column:
    return c.cast("double")


def _spend(df: DataFrame, spend: DataFrame | None, *tenant: str) -> DataFrame:
    """Spend of each supplier, from ``spend`` (by tenant and supplier) if it is given."""
    if spend is None:
        return supplier_spend(df, *tenant)
    return spend if tenant else spend.groupBy("canonical_supplier_id").agg(F.sum("spend").cast("decimal(28,2)").alias("spend"))


def abc(df: DataFrame, ties_share: bool = False, a: float = 0.80, b: float = 0.95, spend: DataFrame | None = None) -> DataFrame:
    """Segment of each supplier within its tenant by the share that it and all larger ones have.

    Row by row in falling order, ties by id; with ``ties_share`` equal suppliers share the sum, as
    a default window frame has it. Tenants whose sum is 0 are left out.
    """
    rows = with_running(_spend(df, spend, "engagement_id"), "spend", "canonical_supplier_id", ("engagement_id",), ties_share).where("all_value <> 0")
    rows = rows.withColumn("share", _exact(F.col("until")) / _exact(F.col("all_value")))
    segment = F.when(F.col("share") <= a, "A").when(F.col("share") <= b, "B").otherwise("C")
    return rows.select("engagement_id", "canonical_supplier_id", _exact(F.col("spend")).alias("total_spend"), F.round("share", 6).alias("cumulative_pct"), segment.alias("abc_segment"))


def tail(df: DataFrame, head: float = 0.80, few: int = 10, spend: DataFrame | None = None) -> DataFrame:
    """``is_tail_spend`` of each supplier: what stands before it is ``head`` of the spend or more; with fewer than ``few`` suppliers, its spend is under the median."""
    rows = flag_tail(with_running(_spend(df, spend), "spend", "canonical_supplier_id"), head, few)
    return rows.select("canonical_supplier_id", _exact(F.col("spend")).alias("total_spend"), "is_tail_spend")


def flag_tail(rows: DataFrame, head: float = 0.80, few: int = 10) -> DataFrame:
    """``rows`` (a supplier each, with the columns of ``with_running`` over ``spend``) with ``is_tail_spend``."""
    # one row; an exact median needs no order of all rows in one task where there are many suppliers
    middle = rows.where(F.col("all_rows") < few).agg(F.median(_exact(F.col("spend"))).alias("middle"))
    flag = F.when(F.col("all_rows") < few, _exact(F.col("spend")) < F.col("middle")).otherwise(numbers.ratio(F.col("before"), F.col("all_value")) >= head)
    return rows.join(F.broadcast(middle)).withColumn("is_tail_spend", flag)


def with_tail_flag(df: DataFrame, spend: DataFrame | None = None) -> DataFrame:
    """``df`` with ``is_tail_spend``; false where the supplier isn't known."""
    flags = tail(df, spend=spend).select("canonical_supplier_id", "is_tail_spend")
    return look_up(df, flags, "canonical_supplier_id").withColumn("is_tail_spend", F.coalesce("is_tail_spend", F.lit(False)))


def tail_share(df: DataFrame, head: float = 0.80) -> DataFrame:
    """One row: the share of spend of suppliers behind the first ``head``, null suppliers counted as one."""
    rows = addressable(df).groupBy("canonical_supplier_id").agg(F.sum(F.col("base_amount").cast("decimal(18,2)")).alias("spend"))
    rows = with_running(rows, "spend", "canonical_supplier_id")
    behind = numbers.total(F.when(_exact(F.col("before")) >= head * _exact(F.col("all_value")), F.col("spend")))
    return rows.agg(F.round(numbers.ratio(behind, F.max("all_value")), 4).alias("tail_spend_pct"))


def concentration(df: DataFrame, spend: DataFrame | None = None) -> DataFrame:
    """One row: HHI in points, shares of the 10, 20 and 50 largest, how many suppliers make 80 %."""
    return concentration_of(with_running(_spend(df, spend), "spend", "canonical_supplier_id"))


def concentration_of(rows: DataFrame) -> DataFrame:
    """``concentration`` of suppliers with the columns of ``with_running`` over ``spend``."""
    share = numbers.ratio(F.col("spend"), F.col("all_value"))
    top = lambda n: F.round(numbers.ratio(F.sum(F.when(F.col("rank") <= n, F.col("spend"))), F.max("all_value")), 4).alias(f"top_{n}_pct")
    pareto = F.least(F.count_if(numbers.ratio(F.col("until"), F.col("all_value")) < 0.8) + 1, F.count(F.lit(1)))
    return rows.agg(F.round(F.coalesce(F.sum(share * share) * 10_000, F.lit(0.0)), 2).alias("hhi"), top(10), top(20), top(50), pareto.alias("pareto_80_count"))


def pareto_curve(df: DataFrame) -> DataFrame:
    """Rank of each supplier and the cumulative percentage."""
    rows = with_running(supplier_spend(df), "spend", "canonical_supplier_id")
    return rows.select("rank", "canonical_supplier_id", _exact(F.col("spend")).alias("total_spend"), F.round(numbers.ratio(F.col("until"), F.col("all_value")) * 100, 4).alias("cumulative_pct"))


def top_with_share(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest suppliers with cumulative percentages of their own total."""
    rows = supplier_spend(df).orderBy(F.desc("spend"), "canonical_supplier_id").limit(n)
    order = Window.orderBy(F.desc("spend"), "canonical_supplier_id")
    until, whole = F.sum("spend").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("spend").over(Window.partitionBy())
    return rows.select("canonical_supplier_id", _exact(F.col("spend")).alias("total_spend"), F.round(numbers.ratio(until, whole) * 100, 4).alias("cumulative_pct"))


def tenant_share(df: DataFrame) -> DataFrame:
    """Each supplier's share of its tenant's total."""
    rows = supplier_spend(df, "engagement_id")
    # summed apart, so that a tenant's suppliers needn't be in one task
    whole = rows.groupBy(F.col("engagement_id").alias("_tenant")).agg(F.sum("spend").alias("_whole"))
    rows = rows.join(whole, F.col("engagement_id").eqNullSafe(F.col("_tenant")))
    return rows.select("engagement_id", "canonical_supplier_id", _exact(F.col("spend")).alias("total_spend"), F.round(numbers.ratio(F.col("spend"), F.col("_whole")), 6).alias("share"))


def first_by_confidence(log: DataFrame, key: str = "raw_supplier_name") -> DataFrame:
    """One row per key: the surest, ties by supplier id."""
    order = Window.partitionBy(key).orderBy(F.col("confidence").desc_nulls_last(), F.col("canonical_supplier_id").asc_nulls_last())
    return log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
