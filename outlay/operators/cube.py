"""Aggregates of spend: the cube's views and the figures behind each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.config import DEFAULT, Settings
from outlay.functions import dates, numbers
from outlay.operators.filters import addressable
from outlay.sources.scratch import stored


def with_time(df: DataFrame) -> DataFrame:
    """Adds ``invoice_year``, ``invoice_month`` and ``invoice_quarter``."""
    d = F.col("invoice_date")
    return df.withColumns({"invoice_year": F.year(d), "invoice_month": dates.month(d), "invoice_quarter": dates.quarter(d)})


def _measures() -> list[Column]:
    return [
        numbers.total(F.col("base_amount")).alias("total_spend"),
        F.count("invoice_number").alias("invoice_count"),
        F.count("po_number").alias("po_count"),
        F.round(F.avg("payment_terms_days"), 4).alias("avg_payment_terms"),
    ]


def view(df: DataFrame, *keys: str) -> DataFrame:
    """One view of the cube over addressable rows; null keys are a group."""
    return addressable(df).groupBy(*keys).agg(*_measures())


#: The cube's views by name, with their keys.
VIEWS = {
    "by_supplier": ("canonical_supplier_name", "parent_company_name"),
    "by_category": ("category_l1", "category_l2", "category_l3"),
    "by_bu": ("business_unit", "cost_centre"),
    "by_month": ("invoice_month",),
    "by_payment_terms": ("payment_terms_bucket",),
}
#: Spend of each supplier of each tenant, which segments, tail and concentration begin with.
SUPPLIERS = ("engagement_id", "canonical_supplier_id")


def _timed(df: DataFrame) -> DataFrame:
    timed = with_time(df) if "invoice_date" in df.columns else df
    return timed.withColumn("payment_terms_bucket", numbers.terms_bucket(F.col("payment_terms_days")))


def sums(df: DataFrame, sets: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """Measures of addressable rows by each of several sets of keys, in one pass: a stored table of sums and counts, split by the set. Null keys are a group."""
    columns = list(dict.fromkeys(k for keys in sets.values() for k in keys))
    terms = F.col("payment_terms_days")
    parts = [F.sum(F.col("base_amount").cast("decimal(18,2)")).alias("spend"), F.count("invoice_number").alias("invoice_count"), F.count("po_number").alias("po_count"), F.sum(terms.cast("double")).alias("terms"), F.count(terms).alias("with_terms")]
    grouped = addressable(df).groupingSets([[F.col(k) for k in keys] for keys in sets.values()], *[F.col(c) for c in columns])
    every = stored(grouped.agg(F.grouping_id(*columns).alias("set_id"), *parts), "cube", narrow=True)
    # a bit for each column that a set doesn't have, the first column's the highest
    number = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for name, keys in sets.items()}
    return {name: every.where(F.col("set_id") == number[name]).select(*keys, "spend", "invoice_count", "po_count", "terms", "with_terms") for name, keys in sets.items()}


def measures_of(rows: DataFrame, *keys: str) -> DataFrame:
    """A view from its sums."""
    average = F.round(F.try_divide(F.col("terms"), F.col("with_terms")), 4)
    return rows.select(*keys, numbers.money(F.col("spend")).alias("total_spend"), "invoice_count", "po_count", average.alias("avg_payment_terms"))


def cube(df: DataFrame, *more: str) -> dict[str, DataFrame]:
    """All views by name whose keys ``df`` has, from one pass over it, and ``transactions``. ``more``: ``supplier_spend`` too, by tenant and supplier."""
    timed = _timed(df)
    sets = {name: keys for name, keys in VIEWS.items() if set(keys) <= set(timed.columns)} | ({"supplier_spend": SUPPLIERS} if "supplier_spend" in more else {})
    found = sums(timed, sets)
    views = {name: measures_of(found[name], *keys) for name, keys in sets.items() if name in VIEWS} | {"transactions": timed}
    if "supplier_spend" in found:
        views["supplier_spend"] = found["supplier_spend"].where("canonical_supplier_id is not null").select(*SUPPLIERS, "spend")
    return views


def overview(df: DataFrame) -> DataFrame:
    """One row: totals, distinct counts, freshness, share of spend without a purchase order."""
    rows = addressable(df)
    spend = numbers.total(F.col("base_amount"))
    out = rows.agg(
        spend.alias("total_spend"),
        F.count(F.lit(1)).alias("invoice_count"),
        F.countDistinct("canonical_supplier_id").alias("supplier_count"),
        F.countDistinct("category_l1").alias("category_count"),
        F.max("invoice_date").alias("data_freshness"),
        numbers.total(F.when(F.col("po_number").isNull(), F.col("base_amount"))).alias("maverick_spend"),
    )
    return out.withColumn("maverick_spend_pct", F.round(numbers.ratio(F.col("maverick_spend"), F.col("total_spend")), 4)).drop("maverick_spend")


def by(df: DataFrame, keys: list[str], *more: Column, tax_lines: bool = False) -> DataFrame:
    """Spend, lines and ``more`` by ``keys`` over addressable rows."""
    return addressable(df, tax_lines).groupBy(*keys).agg(numbers.total(F.col("base_amount")).alias("total_spend"), F.count(F.lit(1)).alias("transaction_count"), *more)


#: Columns a page may be sorted by.
SORTABLE = ("total_spend", "transaction_count", "avg_payment_terms", "canonical_supplier_name")


def supplier_page(df: DataFrame, sort: str = "total_spend", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of suppliers with the number of all of them; order decided to the last by name and parent."""
    if sort not in SORTABLE:
        raise ValueError(f"can't sort by {sort}")
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000, offset 0 or more")
    keys = ["canonical_supplier_id", "canonical_supplier_name", "parent_company_name"]
    rows = by(df, keys, F.round(F.avg("payment_terms_days"), 4).alias("avg_payment_terms"), F.max("invoice_date").alias("last_invoice"))
    count = rows.agg(F.count_distinct(F.coalesce("canonical_supplier_id", F.lit(""))).alias("total_count"))
    first = F.col(sort).desc() if descending else F.col(sort).asc()
    # one row is added to each
    return rows.orderBy(first, *[F.col(k).asc_nulls_first() for k in keys]).offset(offset).limit(limit).join(F.broadcast(count))


def by_category(df: DataFrame) -> DataFrame:
    return by(df, ["category_l1", "category_l2", "category_l3", "unspsc_code"], F.countDistinct("canonical_supplier_id").alias("supplier_count"))


def by_month(df: DataFrame, partial: bool = False) -> DataFrame:
    """Spend by month with the mean of the last three listed months: null in the first two, or (``partial``) of as many as there are."""
    months = by(with_time(df).where(F.col("invoice_month").isNotNull()), ["invoice_month"])
    # one row a month
    last = Window.orderBy("invoice_month").rowsBetween(-2, 0)
    mean = F.round(F.avg("total_spend").over(last), 2)
    return months.withColumn("rolling_3m", mean if partial else F.when(F.count(F.lit(1)).over(last) == 3, mean))


def by_payment_terms(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Wide bands of known terms, tax lines included: share of spend and the value of moving to the target."""
    rows = df.where(F.col("payment_terms_days").isNotNull()).withColumn("bucket", numbers.terms_bucket_wide(F.col("payment_terms_days")))
    rows = by(rows, ["bucket"], tax_lines=True)
    all_spend = F.sum(F.col("total_spend").cast("decimal(18,2)")).over(Window.partitionBy()).cast("double")
    gap = (settings.target_payment_days - numbers.bucket_midpoint(F.col("bucket"))) / 365.0
    return rows.withColumn("spend_pct", F.round(numbers.ratio(F.col("total_spend"), all_spend), 4)).withColumn("wc_opportunity", F.round(F.greatest(F.lit(0.0), gap * F.col("total_spend") * settings.wacc), 2))


def by_business_unit(df: DataFrame) -> DataFrame:
    """Tax lines included."""
    return by(df, ["business_unit", "cost_centre"], F.countDistinct("canonical_supplier_id").alias("supplier_count"), tax_lines=True)


def by_legal_entity(df: DataFrame) -> DataFrame:
    return by(df, ["legal_entity"], F.countDistinct("canonical_supplier_id").alias("supplier_count"), F.countDistinct("category_l1").alias("category_count"))


def by_currency(df: DataFrame) -> DataFrame:
    return by(df, ["original_currency"], numbers.total(F.abs("base_amount")).alias("gross_spend"))


def by_country(df: DataFrame) -> DataFrame:
    return by(df.where(F.col("vendor_country").isNotNull()), ["vendor_country"], F.countDistinct("canonical_supplier_id").alias("supplier_count")).withColumn("country_type", F.lit("vendor"))


def categorisation_totals(df: DataFrame) -> DataFrame:
    sure = F.count_if(F.col("category_confidence") >= 0.6)
    all_rows = F.count(F.lit(1))
    return df.agg(all_rows.alias("total_transactions"), sure.alias("categorised_count"), (all_rows - sure).alias("uncategorised_count"), F.round(numbers.ratio(sure, all_rows), 4).alias("categorised_pct"))


def categorisation_methods(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("category_method").isNotNull())
    return rows.groupBy(F.col("category_method").alias("method")).agg(F.count(F.lit(1)).alias("count"), numbers.total(F.col("base_amount")).alias("spend"), F.round(F.avg("category_confidence"), 4).alias("avg_confidence"))


def categorisation_bands(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("category_confidence").isNotNull())
    return rows.groupBy(numbers.confidence_band(F.col("category_confidence")).alias("band")).agg(F.count(F.lit(1)).alias("count"), numbers.total(F.col("base_amount")).alias("spend"))


def categorisation_backlog(df: DataFrame, limit: int = 50) -> DataFrame:
    """The largest rows without a sure category."""
    from outlay.operators.filters import needs_category_review

    rows = df.where(needs_category_review()).select("transaction_id", "raw_supplier_name", F.col("base_amount").cast("double").alias("base_amount"), "category_l1", "category_confidence")
    return rows.orderBy(F.abs("base_amount").desc(), "transaction_id").limit(limit)


def largest(df: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The groups with most spend."""
    rows = addressable(df).where(F.col(key).isNotNull()).groupBy(key).agg(numbers.total(F.col("base_amount")).alias("total_spend"))
    return rows.orderBy(F.desc("total_spend"), key).limit(limit)


def summary(df: DataFrame, settings: Settings = DEFAULT, limit: int = 10) -> dict[str, DataFrame]:
    """All that the summary page shows, from one pass over addressable rows: ``kpis``, ``by_month``, ``top_suppliers``, ``by_category``, ``by_payment_terms``.

    Rows are added up by five sets of keys; distinct counts are taken from groups that have the counted column among their keys.
    """
    rows = with_time(addressable(df)).withColumn("bucket", numbers.terms_bucket_wide(F.col("payment_terms_days")))
    supplier, category = ("canonical_supplier_id", "canonical_supplier_name"), ("category_l1", "category_l2", "canonical_supplier_id")
    sets = {"all": (), "month": ("invoice_month",), "supplier": supplier, "category": category, "terms": ("bucket",)}
    columns = list(dict.fromkeys(k for keys in sets.values() for k in keys))
    amount = F.col("base_amount").cast("decimal(18,2)")
    values = {"spend": F.sum(amount), "n": F.count(F.lit(1)), "terms": F.sum(F.col("payment_terms_days").cast("double")), "with_terms": F.count("payment_terms_days"), "latest": F.max("invoice_date"), "maverick": F.sum(F.when(F.col("po_number").isNull(), amount))}
    grouped = rows.groupingSets([[F.col(k) for k in keys] for keys in sets.values()], *[F.col(c) for c in columns])
    every = stored(grouped.agg(F.grouping_id(*columns).alias("set_id"), *[v.alias(k) for k, v in values.items()]), "summary", narrow=True)
    number = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for name, keys in sets.items()}
    of = {name: every.where(F.col("set_id") == k) for name, k in number.items()}
    line = [numbers.money(F.col("spend")).alias("total_spend"), F.col("n").alias("transaction_count")]

    counts = of["supplier"].agg(F.count_distinct("canonical_supplier_id").alias("supplier_count")).join(F.broadcast(of["category"].agg(F.count_distinct("category_l1").alias("category_count"))))
    kpis = of["all"].agg(numbers.money(F.sum("spend")).alias("total_spend"), F.coalesce(F.sum("n"), F.lit(0)).alias("invoice_count"), F.max("latest").alias("data_freshness"), F.sum("maverick").alias("maverick"))
    kpis = kpis.join(F.broadcast(counts)).withColumn("maverick_spend_pct", numbers.half_even(numbers.ratio(F.col("maverick"), F.col("total_spend")), 4)).drop("maverick")
    months = of["month"].where("invoice_month is not null").select("invoice_month", *line)
    last = Window.orderBy("invoice_month").rowsBetween(-2, 0)  # one row a month
    months = months.withColumn("rolling_3m", F.when(F.count(F.lit(1)).over(last) == 3, numbers.half_even(F.avg("total_spend").over(last), 2)))
    top = of["supplier"].select(*supplier, *line, F.try_divide("terms", "with_terms").alias("avg_payment_days")).orderBy(F.desc("total_spend"), *[F.col(k).asc_nulls_first() for k in supplier]).limit(limit)
    categories = of["category"].where("category_l1 is not null").groupBy("category_l1", "category_l2").agg(numbers.money(F.sum("spend")).alias("total_spend"), F.sum("n").alias("transaction_count"), F.count_distinct("canonical_supplier_id").alias("supplier_count"))
    terms = of["terms"].where("bucket is not null").select("bucket", *line)
    gap = (settings.target_payment_days - numbers.bucket_midpoint(F.col("bucket"))) / 365.0
    share = numbers.ratio(F.col("total_spend"), F.sum("total_spend").over(Window.partitionBy()))  # four rows
    terms = terms.withColumns({"spend_pct": numbers.half_even(share, 4), "wc_opportunity": numbers.half_even(F.greatest(F.lit(0.0), gap * F.col("total_spend") * settings.wacc), 2)})
    return {"kpis": kpis, "by_month": months, "top_suppliers": top, "by_category": categories, "by_payment_terms": terms}


def batch_status(landing: DataFrame) -> DataFrame:
    return landing.groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("rows"))


def sql_views(df: DataFrame) -> None:
    """Registers the views that reports query by SQL: v_transactions, v_by_* and v_abc_analysis."""
    from outlay.operators import segments

    df.createOrReplaceTempView("v_transactions")
    for name, frame in {"supplier": by(df, ["canonical_supplier_id", "canonical_supplier_name"]), "category": by_category(df), "month": by_month(df), "payment_terms": by_payment_terms(df), "bu": by_business_unit(df), "legal_entity": by_legal_entity(df), "currency": by_currency(df), "country": by_country(df)}.items():
        frame.createOrReplaceTempView(f"v_by_{name}")
    segments.abc(df, ties_share=True).createOrReplaceTempView("v_abc_analysis")
