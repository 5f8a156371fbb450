"""Row filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions import text
from outlay.functions.numbers import terms_bucket_wide


def addressable_rows(tax_lines: bool = False) -> Column:
    """Neither intercompany nor (unless ``tax_lines``) a tax line; null flags pass."""
    out = F.coalesce(F.col("is_intercompany"), F.lit(0)) == 0
    return out if tax_lines else out & (F.coalesce(F.col("is_tax_line"), F.lit(0)) == 0)


def addressable(df: DataFrame, tax_lines: bool = False) -> DataFrame:
    return df.where(addressable_rows(tax_lines))


@dataclass(frozen=True)
class FilterSpec:
    """The whole filter model; an empty selection lets all rows pass. Dates are yyyy-MM-dd, both ends inclusive."""

    date_from: str | None = None
    date_to: str | None = None
    engagements: tuple[str, ...] = ()
    business_units: tuple[str, ...] = ()
    category_l1s: tuple[str, ...] = ()
    category_l2s: tuple[str, ...] = ()
    category_l3s: tuple[str, ...] = ()
    supplier_ids: tuple[str, ...] = ()
    legal_entities: tuple[str, ...] = ()
    currencies: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    categorised: bool | None = None
    abc: tuple[str, ...] = ()
    terms_buckets: tuple[str, ...] = ()
    supplier_text: str | None = None
    least_confidence: float | None = None
    columns: dict[str, str] = field(
        default_factory=lambda: {
            "engagements": "engagement_id", "business_units": "business_unit", "category_l1s": "category_l1", "category_l2s": "category_l2",
            "category_l3s": "category_l3", "supplier_ids": "canonical_supplier_id", "legal_entities": "legal_entity",
            "currencies": "original_currency", "countries": "vendor_country", "abc": "abc_segment",
        }
    )


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Rows that pass every part of ``spec``."""
    if spec.date_from:
        df = df.where(F.col("invoice_date") >= F.lit(spec.date_from).cast("date"))
    if spec.date_to:
        df = df.where(F.col("invoice_date") <= F.lit(spec.date_to).cast("date"))
    for name, column in spec.columns.items():
        if chosen := getattr(spec, name):
            df = df.where(F.col(column).isin(*chosen))
    if spec.terms_buckets:
        df = df.where(terms_bucket_wide(F.col("payment_terms_days")).isin(*spec.terms_buckets))
    if spec.supplier_text:
        df = df.where(text.contains_text(F.col("canonical_supplier_name"), spec.supplier_text))
    if spec.categorised is not None:
        known = F.coalesce(F.col("category_confidence"), F.lit(0.0)) >= 0.6
        df = df.where(known if spec.categorised else ~known)
    if spec.least_confidence is not None:
        df = df.where(F.col("category_confidence") >= spec.least_confidence)
    return df


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def needs_category_review(with_nulls: bool = True, below: float = 0.6) -> Column:
    """Confidence under ``below``; missing confidence counts too, or (``with_nulls`` False) doesn't."""
    low = F.col("category_confidence") < below
    return low | F.col("category_confidence").isNull() if with_nulls else low


def split_by_confidence(df: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(sure rows, rows for review)."""
    sure = F.coalesce(F.col("category_confidence"), F.lit(0.0)) >= least
    return df.where(sure), df.where(~sure)


def owned(df: DataFrame, engagements: DataFrame, owner: str) -> DataFrame:
    """Rows of tenants that belong to ``owner``."""
    return df.join(engagements.where(F.col("owner") == owner).select("engagement_id"), "engagement_id", "left_semi")


#: The rows behind each diagnostic.
PROBLEMS = {
    "missing_supplier_name": lambda: F.col("raw_supplier_name").isNull(),
    "uncategorised_spend": lambda: F.col("category_l1").isNull(),
    "unresolved_suppliers": lambda: F.col("canonical_supplier_id").isNull(),
    "missing_payment_terms": lambda: F.col("payment_terms_days").isNull(),
    "negative_reversal_lines": lambda: F.col("base_amount") < 0,
    "weak_descriptions": lambda: text.weak_description_words(F.col("raw_line_description")),
    "missing_contract_linkage": lambda: F.col("po_number").isNull() & F.col("contract_id").isNull(),
    "missing_bu_cost_centre": lambda: F.col("business_unit").isNull() & F.col("cost_centre").isNull(),
}


def latest(df: DataFrame, column: str, limit: int, *ties: str) -> DataFrame:
    """The newest rows first, those without a time last."""
    return df.orderBy(F.col(column).desc_nulls_last(), *ties).limit(limit)


def oldest(df: DataFrame, column: str, limit: int, *ties: str) -> DataFrame:
    """The oldest rows first, those without a time last."""
    return df.orderBy(F.col(column).asc_nulls_last(), *ties).limit(limit)


#: What a page shows of each row that a check complains about, besides what the check looks at.
SHOWN = ("transaction_id", "invoice_number", "raw_supplier_name", "base_amount")


def problem_page(df: DataFrame, check: str, limit: int = 200) -> DataFrame:
    """The largest rows behind a check, with the columns that a page shows."""
    rows = problem_rows(df, check).select(*[F.col(c).cast("double").alias(c) if c == "base_amount" else c for c in SHOWN])
    return rows.orderBy(F.abs("base_amount").desc(), "transaction_id").limit(limit)


def problem_rows(df: DataFrame, check: str) -> DataFrame:
    """Rows that ``check`` complains about; duplicates come with their number as ``occurrences``."""
    if check == "duplicate_invoice_risk":
        from outlay.operators.quality import duplicate_rows

        return duplicate_rows(df)
    return df.where(PROBLEMS[check]())
