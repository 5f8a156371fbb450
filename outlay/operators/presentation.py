"""What pages and charts show: pivots, histograms, box plots, folded tails, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.config import DEFAULT, Settings
from outlay.functions import numbers
from outlay.operators import quantiles
from outlay.operators.filters import addressable

STANDARD_TERMS = (14, 30, 45, 60, 90)


def pivot(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Spend by ``rows`` with a column for each of ``values``; 0 where there is none."""
    kept = addressable(df).where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return kept.groupBy(rows).pivot(columns, values).agg(numbers.total(F.col("base_amount"))).na.fill(0.0, values)


def supplier_bucket_pivot(df: DataFrame, top: int = 20) -> DataFrame:
    """The largest suppliers' spend by narrow bands of terms."""
    rows = addressable(df).where("canonical_supplier_name is not null").withColumn("bucket", numbers.terms_bucket(F.col("payment_terms_days")))
    first = rows.groupBy("canonical_supplier_name").agg(F.sum(F.col("base_amount").cast("decimal(18,2)")).alias("spend")).orderBy(F.desc("spend"), "canonical_supplier_name").limit(top)
    buckets = ["0-14", "15-30", "31-45", "46-60", "60+", "Unknown"]
    return pivot(rows.join(first, "canonical_supplier_name", "left_semi"), "canonical_supplier_name", "bucket", buckets)


def fold_tail(df: DataFrame, key: str, n: int = 8, most_names: int = 30) -> DataFrame:
    """The ``n`` largest groups and one of all others, with the first names in it."""
    rows = addressable(df).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("name")).agg(F.sum(F.col("base_amount").cast("decimal(18,2)")).alias("spend"))
    top = rows.orderBy(F.desc("spend"), "name").limit(n)
    others = rows.join(top.select("name"), "name", "left_anti")
    # only the names that are listed are collected
    names = others.orderBy(F.desc("spend"), "name").limit(most_names).agg(F.array_sort(F.collect_list("name")).alias("names"))
    rest = others.agg(F.sum("spend").alias("spend"), F.count(F.lit(1)).alias("folded")).where("folded > 0").join(F.broadcast(names))
    rest = rest.select(F.lit("Other").alias("name"), numbers.money(F.col("spend")).alias("total_spend"), "folded", F.array_join("names", ", ").alias("folded_names"))
    return top.select("name", numbers.money(F.col("spend")).alias("total_spend"), F.lit(0).cast("long").alias("folded"), F.lit("").alias("folded_names")).unionByName(rest)


def histogram(df: DataFrame, column: str, width: int = 5) -> DataFrame:
    """Rows and spend by bins of a fixed width."""
    start = (F.floor(F.col(column) / width) * width).cast("int")
    return addressable(df).where(F.col(column).isNotNull()).groupBy(start.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), numbers.total(F.col("base_amount")).alias("total_spend"))


def bins(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Rows by ``n`` bins of equal width between the smallest and the largest value."""
    value = F.col(column).cast("double")
    rows = addressable(df).where(F.col(column).isNotNull())
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    at = F.least(F.floor(F.coalesce(F.try_divide(value - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * n), F.lit(n - 1)).cast("int")
    return rows.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def box_plot(df: DataFrame, key: str = "category_l1") -> DataFrame:
    """Quartiles of positive amounts by ``key``."""
    rows = quantiles.exact(addressable(df).where(F.col("base_amount") > 0), key, F.col("base_amount"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return rows.withColumns({n: F.round(n, 4) for n in ("q1", "median", "q3")})


def terms_against_median(df: DataFrame) -> DataFrame:
    """Each supplier's mean terms beside the median of its most frequent category, the first of equals."""
    rows = addressable(df).where("payment_terms_days is not null and category_l1 is not null and canonical_supplier_id is not null")
    middle = rows.groupBy("category_l1").agg(F.median("payment_terms_days").alias("category_median"))
    each = rows.groupBy("canonical_supplier_id").agg(F.round(F.avg("payment_terms_days"), 4).alias("mean_terms"), F.mode("category_l1", True).alias("category_l1"))
    return each.join(middle, "category_l1")


def supplier_scatter(df: DataFrame) -> DataFrame:
    """Spend, terms, lines and most frequent category of each supplier."""
    rows = addressable(df).where("payment_terms_days is not null and canonical_supplier_id is not null")
    return rows.groupBy("canonical_supplier_id").agg(numbers.total(F.col("base_amount")).alias("total_spend"), F.round(F.avg("payment_terms_days"), 4).alias("mean_terms"), F.count(F.lit(1)).alias("rows"), F.mode("category_l1", True).alias("category_l1"))


def category_opportunity(df: DataFrame, least_suppliers: int = 2) -> DataFrame:
    rows = addressable(df).where(F.col("category_l2").isNotNull()).groupBy("category_l2")
    return rows.agg(numbers.total(F.col("base_amount")).alias("total_spend"), F.countDistinct("canonical_supplier_id").alias("supplier_count"), F.count(F.lit(1)).alias("rows")).where(F.col("supplier_count") >= least_suppliers)


def non_standard_terms(df: DataFrame) -> DataFrame:
    """Suppliers' lines with terms that are none of the usual ones."""
    rows = addressable(df).where("payment_terms_days is not null and canonical_supplier_id is not null")
    rows = rows.where(~F.bround(F.col("payment_terms_days").cast("double"), 0).isin(*[float(t) for t in STANDARD_TERMS]))
    return rows.groupBy("canonical_supplier_id").agg(F.round(F.avg("payment_terms_days"), 4).alias("mean_terms"), numbers.total(F.col("base_amount")).alias("total_spend"), F.count(F.lit(1)).alias("rows"))


def working_capital_table(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """By supplier: gross spend, mean terms, what the target would free."""
    rows = addressable(df).where("payment_terms_days is not null and canonical_supplier_id is not null").groupBy("canonical_supplier_id")
    rows = rows.agg(F.sum(F.abs(F.col("base_amount").cast("decimal(18,2)"))).cast("double").alias("gross_spend"), F.avg("payment_terms_days").alias("terms"))
    gain = F.greatest(F.lit(0.0), (settings.target_payment_days - F.col("terms")) / 365.0 * F.col("gross_spend") * settings.wacc)
    return rows.select("canonical_supplier_id", "gross_spend", F.round("terms", 4).alias("mean_terms"), F.round(gain, 2).alias("opportunity"))


def category_rollup(df: DataFrame, add_counts: bool = True) -> DataFrame:
    """Level 1 and 2 totals. ``add_counts``: supplier counts of the level-3 rows are added up, as the page does; else suppliers are counted once."""
    if add_counts:
        from outlay.operators.cube import by_category

        rows = by_category(df)
        measures = [F.sum(F.col("total_spend").cast("decimal(18,2)")).cast("double").alias("total_spend"), F.sum("supplier_count").alias("supplier_count"), F.sum("transaction_count").alias("transaction_count")]
    else:
        rows = addressable(df)
        measures = [numbers.total(F.col("base_amount")).alias("total_spend"), F.countDistinct("canonical_supplier_id").alias("supplier_count"), F.count(F.lit(1)).alias("transaction_count")]
    name = lambda c: F.coalesce(F.col(c), F.lit("Uncategorised"))
    out = rows.select(name("category_l1").alias("l1"), name("category_l2").alias("l2"), *[c for c in rows.columns if c not in ("category_l1", "category_l2")]).rollup("l1", "l2").agg(*measures)
    return out.where("l1 is not null").withColumn("fragmentation", numbers.fragmentation(F.col("supplier_count")))


def by_parent(df: DataFrame) -> DataFrame:
    """Groups of parents; suppliers without one are a group of their own, last."""
    parent = F.coalesce("parent_company_name", F.lit("Independent"))
    rows = addressable(df).groupBy(parent.alias("parent"), F.col("parent_company_name").isNull().alias("independent"))
    return rows.agg(numbers.total(F.col("base_amount")).alias("total_spend"), F.countDistinct("canonical_supplier_id").alias("supplier_count")).orderBy("independent", F.desc("total_spend"), "parent")


def risk_flags(df: DataFrame) -> DataFrame:
    """By supplier: a large share, one category alone, few purchase orders."""
    rows = addressable(df).where("canonical_supplier_id is not null").groupBy("canonical_supplier_id")
    rows = rows.agg(F.sum(F.col("base_amount").cast("decimal(18,2)")).alias("spend"), F.countDistinct("category_l1").alias("categories"), F.sum(F.when(F.col("po_number").isNotNull(), F.col("base_amount").cast("decimal(18,2)"))).alias("with_po"))
    # one row
    rows = rows.join(F.broadcast(rows.agg(F.sum("spend").alias("all_spend")))).withColumn("share", numbers.ratio(F.col("spend"), F.col("all_spend")))
    return rows.select("canonical_supplier_id", (F.col("share") > 0.20).alias("large_share"), (F.col("categories") == 1).alias("one_category"), (numbers.ratio(F.coalesce("with_po", F.lit(0)), F.col("spend")) < 0.5).alias("few_orders"))


def lever_flags(df: DataFrame) -> DataFrame:
    """By level-1 category: many suppliers, maverick spend, short terms, one large supplier."""
    rows = addressable(df).where(F.col("category_l1").isNotNull())
    each = rows.groupBy("category_l1", "canonical_supplier_id").agg(F.sum(F.col("base_amount").cast("decimal(18,2)")).alias("spend"), F.sum(F.when(F.col("po_number").isNull(), F.col("base_amount").cast("decimal(18,2)"))).alias("maverick"), F.sum("payment_terms_days").alias("days"), F.count("payment_terms_days").alias("known"))
    total = F.sum("spend")
    out = each.groupBy("category_l1").agg(
        (F.count("canonical_supplier_id") > 5).alias("many_suppliers"), (numbers.ratio(F.sum("maverick"), total) > 0.15).alias("maverick"),
        F.coalesce(numbers.ratio(F.sum("days"), F.nullif(F.sum("known"), F.lit(0))) < 30, F.lit(False)).alias("short_terms"), (numbers.ratio(F.max(F.when(F.col("canonical_supplier_id").isNotNull(), F.col("spend"))), total) > 0.60).alias("one_large_supplier"),
    )
    return out


def first_known_dimension(df: DataFrame, columns: tuple[str, ...] = ("business_unit", "plant_site", "cost_centre")) -> DataFrame:
    """Spend by the first of the columns that has any value, chosen inside the plan."""
    rows = addressable(df)
    has = rows.agg(*[F.coalesce(F.max(F.col(c).isNotNull()), F.lit(False)).alias(f"_has_{c}") for c in columns])
    chosen = F.coalesce(*[F.when(F.col(f"_has_{c}"), F.coalesce(F.col(c), F.lit("\0"))) for c in columns])
    # ``has`` has one row
    rows = rows.join(F.broadcast(has)).withColumn("dimension", F.nullif(chosen, F.lit("\0"))).where("dimension is not null")
    return rows.groupBy("dimension").agg(numbers.total(F.col("base_amount")).alias("total_spend"))


def split_donut(df: DataFrame) -> DataFrame:
    """Spend by type, else by managed status, else with and without a purchase order: the first that has any value."""
    null = F.lit(None).cast("string")
    column = lambda c: F.col(c) if c in df.columns else null
    rows = addressable(df).withColumns({"_type": column("spend_type"), "_managed": column("managed_status")})
    has = rows.agg(F.coalesce(F.max(F.col("_type").isNotNull()), F.lit(False)).alias("_t"), F.coalesce(F.max(F.col("_managed").isNotNull()), F.lit(False)).alias("_m"))
    label = F.when(F.col("_t"), F.coalesce("_type", F.lit("Unknown"))).when(F.col("_m"), F.coalesce("_managed", F.lit("Unknown"))).otherwise(F.when(F.col("po_number").isNotNull(), "PO").otherwise("No PO"))
    return rows.join(F.broadcast(has)).groupBy(label.alias("label")).agg(numbers.total(F.col("base_amount")).alias("total_spend"))


def trends(df: DataFrame, key: str, chosen: tuple[str, ...]) -> DataFrame:
    """Spend by month of each of several groups."""
    rows = addressable(df).where(F.col(key).isin(*chosen) & F.col("invoice_date").isNotNull())
    return rows.groupBy(key, F.date_format("invoice_date", "yyyy-MM").alias("invoice_month")).agg(numbers.total(F.col("base_amount")).alias("total_spend"))


def trend(df: DataFrame, key: str, value: str) -> DataFrame:
    """Monthly spend of one supplier or category."""
    rows = addressable(df).where((F.col(key) == value) & F.col("invoice_date").isNotNull())
    return rows.groupBy(F.date_format("invoice_date", "yyyy-MM").alias("invoice_month")).agg(numbers.total(F.col("base_amount")).alias("total_spend"))


def breakdown(df: DataFrame, key: str, chosen: tuple[str, ...], by: str, limit: int | None = None) -> DataFrame:
    """Spend of the chosen groups by another column, the largest first, with its ``rank``; nulls are left out after grouping. ``limit`` keeps the first."""
    rows = addressable(df).where(F.col(key).isin(*chosen)).groupBy(by).agg(numbers.total(F.col("base_amount")).alias("total_spend")).where(F.col(by).isNotNull())
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_spend"), by)))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def supplier_options(df: DataFrame) -> DataFrame:
    """Labels of suppliers with their spend, the largest first."""
    rows = addressable(df).where("canonical_supplier_name is not null").groupBy("canonical_supplier_name").agg(numbers.total(F.col("base_amount")).alias("total_spend"))
    return rows.orderBy(F.desc("total_spend"), "canonical_supplier_name").select(F.concat("canonical_supplier_name", F.lit(" ("), F.format_number("total_spend", 0), F.lit(")")).alias("label"), "total_spend")


def freshness(df: DataFrame) -> DataFrame:
    """The latest arrival, as a date in words."""
    return df.agg(F.date_format(F.max("ingested_at"), "d MMMM yyyy").alias("data_freshness"))
