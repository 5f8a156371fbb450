"""Number expressions: money, ratios, buckets, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """A sum of money as double at the edge; null counts as nothing. Sums run over decimals, so that their order doesn't matter."""
    return F.coalesce(c, F.lit(0)).cast("double")


def total(c: Column) -> Column:
    return money(F.sum(c.cast("decimal(18,2)")))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where it can't be told."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def half_even(c: Column, digits: int) -> Column:
    """Rounded with ties to the even digit."""
    return F.bround(c, digits)


def terms_bucket(days: Column) -> Column:
    """Bands of 14, 15, 15, 15 days; unknown where null or negative."""
    d = days.cast("int")
    return F.when(d.isNull() | (d < 0), "Unknown").when(d <= 14, "0-14").when(d <= 30, "15-30").when(d <= 45, "31-45").when(d <= 60, "46-60").otherwise("60+")


def terms_bucket_wide(days: Column) -> Column:
    """Bands of 30 days; null stays null."""
    return F.when(days <= 30, "0-30").when(days <= 60, "31-60").when(days <= 90, "61-90").when(days.isNotNull(), "90+")


def bucket_midpoint(bucket: Column) -> Column:
    """Days that stand for a wide band."""
    return F.when(bucket == "0-30", 15).when(bucket == "31-60", 46).when(bucket == "61-90", 76).when(bucket == "90+", 120).otherwise(45)


def confidence_band(c: Column, high: float = 0.85, medium: float = 0.60) -> Column:
    return F.when(c >= high, "HIGH").when(c >= medium, "MEDIUM").otherwise("LOW")


def status(pct: Column, green: float, amber: float) -> Column:
    return F.when(pct < green, "GREEN").when(pct < amber, "AMBER").otherwise("RED")


def info_status(pct: Column, info: float, warn: float) -> Column:
    return F.when(pct < info, "INFO").when(pct < warn, "WARN").otherwise("ALERT")


def fragmentation(suppliers: Column) -> Column:
    return F.when(suppliers > 5, "Fragmented").when(suppliers >= 3, "Moderate").otherwise("Focused")


def compact(c: Column, label: str = "") -> Column:
    """12.3K, 4.5M, 1.2B."""
    size = F.abs(c)
    text = F.when(size >= 1e9, F.concat(F.format_string("%.1f", c / 1e9), F.lit("B"))).when(size >= 1e6, F.concat(F.format_string("%.1f", c / 1e6), F.lit("M"))).when(size >= 1e3, F.concat(F.format_string("%.1f", c / 1e3), F.lit("K"))).otherwise(F.format_string("%.0f", c))
    return F.concat(F.lit(label), text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; a small addition keeps zero vectors finite."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b) + F.lit(1e-10))


def vector_from_text(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def vector_to_text(c: Column) -> Column:
    return F.to_json(c)
