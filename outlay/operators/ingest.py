"""From raw exports to landed transactions: column mapping, cleaning, currency, hashing, insert-if-absent."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay import reference
from outlay.config import DEFAULT, Settings
from outlay.functions import dates, text
from outlay.operators.joins import look_up
from outlay.sources.scratch import is_small, stored


def detect_source(columns: Iterable[str], mappings: dict[str, dict[str, str]] | None = None) -> str:
    """The mapping that shares most headers, the first of equals; DEFAULT if none shares any."""
    mappings = mappings or reference.COLUMN_MAPPINGS
    have = set(columns)
    best, most = "DEFAULT", 0
    for name, mapping in mappings.items():
        if (shared := len(have & set(mapping))) > most:
            best, most = name, shared
    return best


def map_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Renames source columns; others keep their names."""
    mapping = mapping or reference.COLUMN_MAPPINGS[detect_source(df.columns)]
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def missing_fields(columns: Iterable[str], mapping: dict[str, str], required: Iterable[str] = reference.REQUIRED_FIELDS) -> list[str]:
    """Required fields that neither a mapped nor an own column gives."""
    columns = set(columns)
    covered = {v for k, v in mapping.items() if k in columns} | columns
    return [f for f in required if f not in covered]


def clean_texts(df: DataFrame) -> DataFrame:
    """Texts stripped, stand-ins for nothing made null."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumn("_texts", text.clean_all(F.array(*names))).withColumns({n: F.get("_texts", F.lit(i)) for i, n in enumerate(names)}).drop("_texts") if names else df


def clean(df: DataFrame) -> DataFrame:
    """Texts stripped, stand-ins for nothing made null, document type, terms and flags added."""
    df = clean_texts(df)
    null = F.lit(None).cast("string")
    column = lambda name: F.col(name) if name in df.columns else null
    amount = column("original_amount").try_cast("double")
    description = column("raw_line_description")
    kind = text.document_type(amount, column("invoice_number"))
    return df.withColumns({
        "document_type": kind,
        "payment_terms_days": text.payment_terms_days(column("raw_payment_terms")),
        "is_credit_note": (kind == "CREDIT_NOTE").cast("int"),
        "is_intercompany": text.is_intercompany(column("raw_supplier_name")).cast("int"),
        "is_tax_line": text.is_tax_line(description, column("gl_account")).cast("int"),
        "is_freight_line": text.is_freight_line(description).cast("int"),
    })


def month_rates(rates: DataFrame, base: str) -> DataFrame:
    """Rates into ``base`` with their month's number, the first listed of repeated months."""
    into = rates.where(F.col("to_ccy") == base).withColumn("month", dates.month_ordinal(F.col("year_month")))
    return into.groupBy("from_ccy", "month").agg(F.min_by("rate", "year_month").alias("rate"))


def nearest_rates(needed: DataFrame, rates: DataFrame) -> DataFrame:
    """For each needed (currency, month) the rate of the nearest month, the earlier of two at the same distance.

    Done once a month and currency, not once a row: the months before and behind are found by
    windows over the union of both lists.
    """
    both = needed.select("from_ccy", "month", F.lit(None).cast("double").alias("rate")).distinct().unionByName(rates.select("from_ccy", "month", "rate"))
    both = both.groupBy("from_ccy", "month").agg(F.max("rate").alias("rate"))
    order = Window.partitionBy("from_ccy").orderBy("month")
    known = F.when(F.col("rate").isNotNull(), F.struct("month", "rate"))
    back = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"back": back, "ahead": ahead})
    nearer = F.when(F.col("back").isNull() | (F.col("ahead")["month"] - F.col("month") < F.col("month") - F.col("back")["month"]), F.col("ahead")).otherwise(F.col("back"))
    return both.select("from_ccy", "month", nearer["rate"].alias("rate"), (nearer["month"] != F.col("month")).alias("estimated"))


def every_rate(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``month_rates`` the first and last month of each currency (``from_ccy``, ``first``, ``last``) and the nearest rate of each month between them, as ``nearest_rates`` has it."""
    known = stored(known.where("month is not null and rate is not null"), "rates", narrow=True)
    spans = known.groupBy("from_ccy").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    return spans, nearest_rates(spans.select("from_ccy", F.explode(F.sequence("first", "last")).alias("month")), known)


def convert(df: DataFrame, rates: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``fx_rate``, ``base_amount``, ``fx_warning`` and ``base_currency``.

    The base currency has rate 1. A currency without any rate keeps its amount, without a rate, and a
    warning; a month without a rate takes the nearest one, with a warning; without a date there is no rate.
    Rates are worked out for all months between a currency's first and last, so that the rows are read once and stay where they are.
    """
    base = settings.base_currency
    currency, amount = F.coalesce(F.col("original_currency"), F.lit(base)), F.col("original_amount").cast("decimal(18,2)")
    rows = df.withColumns({"_ccy": currency, "_month": dates.month_ordinal(F.col("invoice_date"))})
    spans, near = every_rate(month_rates(rates, base))
    near = near.select(F.col("from_ccy").alias("_ccy"), F.col("month").alias("_at"), F.col("rate").alias("_rate"), F.col("estimated").alias("_between"))
    rows = look_up(rows, spans.select(F.col("from_ccy").alias("_ccy"), F.col("first").alias("_first"), F.col("last").alias("_last")), "_ccy")
    # a month before the first or behind the last has the rate of that one
    rows = rows.withColumn("_at", F.when(F.col("_month").isNotNull(), F.greatest("_first", F.least("_month", "_last"))))
    rows = look_up(rows, near, ["_ccy", "_at"]).withColumn("_estimated", F.col("_between") | (F.col("_at") != F.col("_month")))
    same = F.col("_ccy") == base
    rate = F.when(same, 1.0).otherwise(F.col("_rate"))
    warning = F.when(same, None).when(F.col("_rate").isNull(), F.when(F.col("_month").isNull(), "MISSING_DATE").otherwise("UNKNOWN_CURRENCY_PAIR")).when(F.col("_estimated"), "RATE_ESTIMATE")
    converted = F.coalesce(F.round(amount * rate.cast("decimal(18,6)"), 2).cast("decimal(18,2)"), amount).cast("double")
    return rows.withColumns({"fx_rate": rate, "base_amount": converted, "fx_warning": warning, "base_currency": F.lit(base)}).drop("_ccy", "_month", "_first", "_last", "_at", "_rate", "_between", "_estimated")


def raw_json(df: DataFrame) -> Column:
    """The row as JSON text, nulls included."""
    return F.to_json(F.struct(*[df[c] for c in df.columns]), {"ignoreNullFields": "false"})


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of the row's texts in column order; null and '' differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), df[c].cast("string")), F.lit("~")) for c in df.columns]).cast("binary"), 256)


def with_metadata(df: DataFrame, source_system: str, source_file: str, engagement_id: str) -> DataFrame:
    """Adds ids, source and time of arrival; row numbers grow with the file but may have gaps."""
    return df.withColumns({
        "transaction_id": F.uuid(), "source_system": F.lit(source_system), "source_file": F.lit(source_file), "engagement_id": F.lit(engagement_id),
        "source_row_number": F.monotonically_increasing_id(), "ingested_at": F.current_timestamp(), "last_modified_at": F.current_timestamp(),
    })


def ingest(raw: DataFrame, rates: DataFrame, engagement_id: str, source_file: str = "", settings: Settings = DEFAULT, mapping: dict[str, str] | None = None) -> DataFrame:
    """All steps from an export of texts to transactions; raises if a required field has no column."""
    source = detect_source(raw.columns)
    mapping = mapping or reference.COLUMN_MAPPINGS[source]
    if missing := missing_fields(raw.columns, mapping):
        raise ValueError(f"no column for {', '.join(missing)}")
    df = raw.withColumns({"raw_data": raw_json(raw), "source_row_hash": row_hash(raw)})
    df = map_columns(df, mapping).withColumn("cleaned_description", text.clean(F.col("raw_line_description")) if "LINE_DESC" in raw.columns or "raw_line_description" in raw.columns else F.lit(None).cast("string"))
    df = df.withColumns({"invoice_date": dates.parse_date(F.col("invoice_date")), "original_amount": text.clean(F.col("original_amount")).try_cast("decimal(18,2)").cast("double")})
    return with_metadata(convert(clean(df), rates, settings), source, source_file, engagement_id)


def insert_absent(incoming: DataFrame, landed: DataFrame, keys: tuple[str, ...] = ("engagement_id", "source_row_hash")) -> DataFrame:
    """Rows whose key isn't landed yet, one a key."""
    return incoming.dropDuplicates(list(keys)).join(landed.select(*keys), list(keys), "left_anti")


def absent_rows(incoming: DataFrame, landed: DataFrame, keys: tuple[str, ...] = ("engagement_id", "source_row_hash")) -> DataFrame:
    """``insert_absent`` for many wide rows that are stored: only those whose key may occur twice are moved.

    Which these are is told by numbers made of the keys, a number a row; rows that share one, few as a rule, are
    looked at in full and written.
    """
    number = F.xxhash64(*keys).alias("_number")
    every = incoming.select(number, F.lit(1).alias("new")).unionByName(landed.select(number, F.lit(0).alias("new")))
    counts = every.groupBy("_number").agg(F.sum("new").alias("new"), F.count(F.lit(1)).alias("rows"))
    several = stored(counts.where("new > 0 and rows > 1").select("_number", F.lit(True).alias("_several")), "several", narrow=True)
    if several.isEmpty():
        return incoming
    marked = look_up(incoming.withColumn("_number", number), several, "_number", small=is_small(several))
    rest = insert_absent(marked.where("_several").select(*incoming.columns), landed, keys)
    return marked.where("_several is null").select(*incoming.columns).unionByName(stored(rest, "several-rows"))


def insert_counts(incoming: DataFrame, landed: DataFrame, keys: tuple[str, ...] = ("engagement_id", "source_row_hash")) -> DataFrame:
    """One row: how many rows are new and how many are not."""
    new = insert_absent(incoming, landed, keys).agg(F.count(F.lit(1)).alias("new_rows"))
    both = incoming.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(new))
    return both.select("new_rows", (F.col("rows") - F.col("new_rows")).alias("duplicate_rows"))


def to_landing(df: DataFrame, batch_id: str) -> DataFrame:
    """Rows of the landing table: key, the columns that promotion needs, the whole row as text, state."""
    columns = ["source_row_hash", "engagement_id", "raw_supplier_name", "raw_supplier_id", "raw_line_description", "gl_account", "base_amount", "raw_data", "ingested_at"]
    have = [c if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(*have).withColumns({"batch_id": F.lit(batch_id), "status": F.lit("queued")})


def queued(landing: DataFrame, engagement_id: str | None = None, batch_id: str | None = None) -> DataFrame:
    rows = landing.where(F.col("status") == "queued")
    rows = rows.where(F.col("engagement_id") == engagement_id) if engagement_id else rows
    return rows.where(F.col("batch_id") == batch_id) if batch_id else rows
