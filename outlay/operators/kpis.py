"""Key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.config import DEFAULT, Settings
from outlay.functions import numbers
from outlay.operators import quality, segments
from outlay.operators.filters import addressable, addressable_rows
from outlay.operators.prefix import with_running
from outlay.sources.scratch import stored


def _known_terms() -> Column:
    return addressable_rows() & F.col("payment_terms_days").isNotNull()


def _sums() -> dict[str, Column]:
    """What the spend figures need from one pass over all rows, besides distinct counts."""
    amount, rows, known = F.col("base_amount"), addressable_rows(), _known_terms()
    on_contract = F.coalesce(F.col("is_on_contract"), F.lit(0)) == 1
    return {
        "s_spend": numbers.total(F.when(rows, amount)), "s_covered": numbers.total(F.when(rows & on_contract, amount)), "s_maverick": numbers.total(F.when(rows & F.col("po_number").isNull() & ~on_contract, amount)),
        "s_weighted": F.sum(F.when(known, amount.cast("decimal(18,2)") * F.col("payment_terms_days"))).cast("double"), "s_with_terms": numbers.total(F.when(known, amount)),
        "s_rows": F.count_if(rows), "s_missing": F.count_if(rows & F.col("payment_terms_days").isNull()),
    }


def _figures() -> list[Column]:
    c = F.col
    return [
        c("s_spend").alias("total_spend"), "total_suppliers", "total_invoices",
        F.round(numbers.ratio(c("s_spend"), c("total_invoices")), 4).alias("avg_transaction_size"),
        F.round(numbers.ratio(c("s_covered"), c("s_spend")), 4).alias("contract_coverage_pct"),
        F.round(numbers.ratio(c("s_maverick"), c("s_spend")), 4).alias("maverick_spend_pct"),
        F.round(numbers.ratio(c("s_weighted"), c("s_with_terms")), 2).alias("weighted_avg_payment_terms"),
        F.round(F.coalesce(F.try_divide(c("s_missing").cast("double"), c("s_rows")), F.lit(1.0)), 4).alias("pct_missing_payment_terms"),
    ]


def spend_figures(df: DataFrame) -> DataFrame:
    """One row: totals, contract cover, maverick share, payment terms."""
    rows = addressable_rows()
    distinct = {n: F.countDistinct(F.when(rows, F.col(c))) for n, c in (("total_suppliers", "canonical_supplier_id"), ("total_invoices", "invoice_number"))}
    return df.agg(*[v.alias(k) for k, v in (_sums() | distinct).items()]).select(*_figures())


def tail_figures(df: DataFrame) -> DataFrame:
    """One row: the tail's share of all rows' spend (not of addressable spend alone) and its suppliers."""
    rows = segments.with_tail_flag(df)
    spend = numbers.total(F.col("base_amount"))
    return rows.agg(
        F.round(numbers.ratio(numbers.total(F.when(F.col("is_tail_spend"), F.col("base_amount"))), spend), 4).alias("tail_spend_pct"),
        F.countDistinct(F.when(F.col("is_tail_spend"), F.col("canonical_supplier_id"))).alias("tail_supplier_count"),
    )


def working_capital(df: DataFrame, settings: Settings = DEFAULT, top: int = 50) -> DataFrame:
    """One row: what the ``top`` suppliers with known terms would free if they moved to the target."""
    rows = addressable(df).where("payment_terms_days is not null and canonical_supplier_id is not null")
    each = rows.groupBy("canonical_supplier_id").agg(F.sum(F.col("base_amount").cast("decimal(18,2)")).alias("spend"), F.avg("payment_terms_days").alias("terms"))
    return _freed(each, settings, top)


def _freed(each: DataFrame, settings: Settings, top: int) -> DataFrame:
    each = each.orderBy(F.desc("spend"), "canonical_supplier_id").limit(top)
    gain = F.greatest(F.lit(0.0), (settings.target_payment_days - F.col("terms")) / 365.0 * F.col("spend").cast("double") * settings.wacc)
    return each.agg(F.round(F.coalesce(F.sum(gain), F.lit(0.0)), 2).alias("working_capital_opportunity"))


def kpis(df: DataFrame, settings: Settings = DEFAULT, top: int = 50) -> DataFrame:
    """One row of all figures, from three passes over the rows: by supplier and raw name (stored, as five figures come from it), by invoice and amount, and all at once."""
    amount, rows, known = F.col("base_amount").cast("decimal(18,2)"), addressable_rows(), _known_terms()
    names = df.groupBy("canonical_supplier_id", "raw_supplier_name").agg(
        F.count_if(rows).alias("rows"), F.sum(F.when(rows, amount)).alias("spend"), F.sum(amount).alias("all_spend"),
        F.count_if(known).alias("terms_rows"), F.sum(F.when(known, F.col("payment_terms_days"))).alias("terms_sum"), F.sum(F.when(known, amount)).alias("terms_spend"),
    )
    names = stored(names, "names")
    suppliers = names.where("canonical_supplier_id is not null").groupBy("canonical_supplier_id").agg(*[F.sum(c).alias(c) for c in ("rows", "spend", "all_spend", "terms_rows", "terms_sum", "terms_spend")])
    suppliers = stored(suppliers.where("rows > 0"), "suppliers")
    running = with_running(suppliers.select("canonical_supplier_id", "spend", "all_spend"), "spend", "canonical_supplier_id")
    tail = segments.flag_tail(running).where("is_tail_spend").agg(F.coalesce(F.sum("all_spend"), F.lit(0)).alias("tail"), F.count(F.lit(1)).alias("tail_supplier_count"))
    whole = names.agg(F.sum("all_spend").alias("everything"))
    tail = tail.join(F.broadcast(whole)).select(F.round(numbers.ratio(F.col("tail"), F.col("everything")), 4).alias("tail_spend_pct"), "tail_supplier_count")
    held = segments.concentration_of(running).select("hhi", F.col("top_10_pct").alias("top_10_supplier_pct"), F.col("pareto_80_count").alias("pareto_80_supplier_count"))
    each = suppliers.where("terms_rows > 0").select("canonical_supplier_id", F.col("terms_spend").alias("spend"), (F.col("terms_sum") / F.col("terms_rows")).alias("terms"))
    freed = _freed(each, settings, top)
    invoices = stored(quality.invoice_counts(df, F.max(rows).alias("addressable")), "invoices")
    counted = invoices.where("addressable").agg(F.countDistinct("invoice_number").alias("total_invoices"))
    one = df.agg(*[v.alias(k) for k, v in (_sums() | quality.values()).items()])
    for part in (suppliers.agg(F.count(F.lit(1)).alias("total_suppliers")), counted, quality._names(names, False), quality._duplicates(invoices, False)):
        one = one.join(F.broadcast(part))
    one = stored(one, "figures")  # one row, read by the figures and by the score
    figures = one.select(*_figures())
    for part in (tail, held, freed, quality.score_of(quality._banded(one))):
        figures = figures.join(F.broadcast(part))
    return figures


def accounts_summary(df: DataFrame) -> DataFrame:
    """One row: spend with a purchase order, short terms, mean month."""
    rows = addressable(df)
    spend = numbers.total(F.col("base_amount"))
    return rows.agg(
        F.round(numbers.ratio(numbers.total(F.when(F.col("po_number").isNotNull(), F.col("base_amount"))), spend), 4).alias("po_coverage_pct"),
        F.countDistinct(F.when(F.col("payment_terms_days") < 30, F.col("canonical_supplier_id"))).alias("short_terms_suppliers"),
        F.round(numbers.ratio(F.sum(F.abs(F.col("base_amount").cast("decimal(18,2)")) * F.col("payment_terms_days")), F.sum(F.when(F.col("payment_terms_days").isNotNull(), F.abs(F.col("base_amount").cast("decimal(18,2)"))))), 2).alias("gross_weighted_terms"),
        F.round(numbers.ratio(spend, F.countDistinct(F.date_format("invoice_date", "yyyy-MM"))), 2).alias("mean_month"),
    )
