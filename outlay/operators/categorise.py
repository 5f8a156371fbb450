"""Spend categories: overrides, ledger codes, suppliers, keywords, vectors, models, in that order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay import reference
from outlay.config import DEFAULT, Settings
from outlay.functions import text
from outlay.operators.joins import look_up, stored_kinds
from outlay.operators.vectors import match_vectors
from outlay.sources.scratch import is_small, stored

RESULT = "struct<l1:string,l2:string,l3:string,unspsc:string,confidence:double,method:string>"


def result(l1, l2, l3, unspsc, confidence, method: str) -> Column:
    return F.struct(l1.alias("l1"), l2.alias("l2"), l3.alias("l3"), unspsc.cast("string").alias("unspsc"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"))


def seed_rules(seeds: DataFrame, kind: str) -> DataFrame:
    """``key``, ``n``, ``r`` of one kind of seed mapping (``GL`` or ``SUPPLIER``); of equal keys the one with the largest ``position`` counts."""
    c = F.col
    key, method = {"GL": (text.gl_normalised(c("source_value")), "GL_MAPPING"), "SUPPLIER": (F.lower(text.strip(c("source_value"))), "SUPPLIER_MAPPING")}[kind]
    r = result(c("internal_category_l1"), c("internal_category_l2"), c("internal_category_l3"), c("unspsc_segment_code"), F.coalesce(c("confidence"), F.lit(0.85)), method)
    rows = seeds.where(c("mapping_type") == kind).select(key.alias("key"), r.alias("r"), F.struct("position", "internal_category_l1", "internal_category_l2").alias("n")).where("key is not null")
    return rows.groupBy("key").agg(F.lit(None).cast("long").alias("n"), F.max_by("r", "n").alias("r"))


def override_rules(overrides: DataFrame, column: str) -> DataFrame:
    """``key``, ``n``, ``r`` of manual decisions by supplier or by ledger code; of several the last made counts."""
    c = F.col
    key = text.gl_normalised(c(column)) if column == "gl_account" else c(column)
    rows = overrides.where(c(column).isNotNull()).select(key.alias("key"), c("override_order").cast("long").alias("n"), result(c("override_l1"), c("override_l2"), c("override_l3"), c("unspsc_code"), F.lit(1.0), "MANUAL").alias("r"))
    return rows.groupBy("key").agg(F.max("n").alias("n"), F.max_by("r", "n").alias("r"))


def rules_of(seeds: DataFrame | None = None, overrides: DataFrame | None = None) -> dict[str, tuple[DataFrame, bool]]:
    """All look-up tables of the passes, written as one, with whether each is small."""
    tables = {} if seeds is None else {kind: seed_rules(seeds, kind) for kind in ("GL", "SUPPLIER")}
    if overrides is not None:
        tables |= {column: override_rules(overrides, column) for column in ("canonical_supplier_id", "gl_account")}
    return stored_kinds(tables)


def _joined(df: DataFrame, rules: tuple[DataFrame, bool], key: str, *columns: str) -> DataFrame:
    """``df`` with ``columns`` for the rule's result and, if named, its number."""
    table, small = rules
    named = table.select(F.col("key").alias(key), *[F.col(x).alias(c) for x, c in zip("rn", columns, strict=False)])
    return look_up(df, named, key, small=small)


def by_override(df: DataFrame, overrides: DataFrame | None, name: str = "by_override", rules: dict | None = None) -> DataFrame:
    """Manual decisions by supplier or by ledger code; of several the last made counts.

    Two equi-joins instead of one on either condition.
    """
    c, rules = F.col, rules or rules_of(overrides=overrides)
    rows = _joined(df, rules["canonical_supplier_id"], "canonical_supplier_id", "_r1", "_n1").withColumn("_gl", text.gl_normalised(c("gl_account")))
    rows = _joined(rows, rules["gl_account"], "_gl", "_r2", "_n2")
    last = F.when(c("_n2").isNull() | (c("_n1") > c("_n2")), c("_r1")).otherwise(c("_r2"))
    return rows.withColumn(name, last).drop("_gl", "_r1", "_n1", "_r2", "_n2")


def by_gl(df: DataFrame, seeds: DataFrame | None, name: str = "by_gl", rules: dict | None = None) -> DataFrame:
    """Ledger code, else its first four characters."""
    found = (rules or rules_of(seeds))["GL"]
    rows = df.withColumn("_gl", text.gl_normalised(F.col("gl_account"))).withColumn("_gl4", F.substring("_gl", 1, 4))
    rows = _joined(_joined(rows, found, "_gl", "_exact"), found, "_gl4", "_prefix")
    return rows.withColumn(name, F.coalesce("_exact", "_prefix")).drop("_gl", "_gl4", "_exact", "_prefix")


def by_supplier(df: DataFrame, seeds: DataFrame | None, name: str = "by_supplier", rules: dict | None = None) -> DataFrame:
    rows = df.withColumn("_supplier", F.lower(text.strip(F.col("canonical_supplier_name"))))
    return _joined(rows, (rules or rules_of(seeds))["SUPPLIER"], "_supplier", name).drop("_supplier")


def searches(pattern: str) -> list[tuple[str, str | None]]:
    """Of a pattern's alternatives (plain texts but for a dot, which stands for any character) the plain text to search for and, where there is a dot, what to try where it stands."""
    words = [w for w in pattern.split("|") if w]
    # an alternative that has another one inside occurs only where that one does
    needed = [w for w in words if not any(o != w and "." not in o and o in w for o in words)]
    # a search for a plain text is far cheaper than one for a pattern; a pattern is tried where its longest plain part stands
    return [(max(w.split("."), key=len), w if "." in w else None) for w in dict.fromkeys(needed)]


def keyword_place(description: Column, rules=reference.KEYWORD_RULES) -> Column:
    """Place (by confidence, the first of equals first) of the surest rule of which an alternative occurs in a lower-case text.

    A loop over the list of searches, no join; a chain of conditions would be too long a program for a row to be compiled. The text should be a column, as each search would work out an expression anew.
    """
    every = [(i, plain, pattern) for i, (whole, *_) in enumerate(_ordered(rules)) for plain, pattern in searches(whole)]
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(plain).alias("plain"), F.lit(pattern).cast("string").alias("pattern")) for i, plain, pattern in every])
    found = lambda s: F.contains(description, s["plain"]) & (s["pattern"].isNull() | F.rlike(description, F.coalesce(s["pattern"], F.lit(""))))
    return F.get(F.filter(listed, found), F.lit(0))["place"] if every else F.lit(None).cast("int")


def _ordered(rules) -> list:
    return sorted(rules, key=lambda r: -r[4])


def keyword_result(place: Column, rules=reference.KEYWORD_RULES) -> Column:
    """The rule's answer."""
    listed = [result(F.lit(l1), F.lit(l2), F.lit(None).cast("string"), F.lit(unspsc), F.lit(confidence), "KEYWORD") for _, l1, l2, unspsc, confidence in _ordered(rules)]
    return F.get(F.array(*listed), place)


def keyword_places(descriptions: DataFrame, rules=reference.KEYWORD_RULES) -> DataFrame | None:
    """``raw_line_description`` and ``_place`` for all descriptions that rows without another text may have, each worked out once; none if they are too many to be looked up."""
    texts = stored(descriptions.select("raw_line_description").where("raw_line_description is not null").distinct(), "descriptions", narrow=True)
    if not is_small(texts):
        return None
    texts = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism).withColumn("_text", F.lower(F.concat(F.lit(" "), "raw_line_description")))
    return stored(texts.select("raw_line_description", keyword_place(F.col("_text"), rules).alias("_place")).where("_place is not null"), "places")


def by_keyword(df: DataFrame, name: str = "by_keyword", rules=reference.KEYWORD_RULES, unless: tuple[str, ...] = (), places: DataFrame | None = None) -> DataFrame:
    """Where one of ``unless`` has an answer, the rules aren't tried. ``places``: see ``keyword_places``; not asked where rows have a cleaned text too."""
    if places is not None and "cleaned_description" not in df.columns:
        rows = look_up(df, places, "raw_line_description", small=True)
        place = F.when(F.coalesce(*unless).isNull(), F.col("_place")) if unless else F.col("_place")
        return rows.withColumn(name, keyword_result(place, rules)).drop("_place")
    cleaned = F.col("cleaned_description") if "cleaned_description" in df.columns else F.lit(None).cast("string")
    description = F.lower(F.concat(F.coalesce(cleaned, F.lit("")), F.lit(" "), F.coalesce(F.col("raw_line_description"), F.lit(""))))
    # a null text has no place: the chain looks at it and goes on
    rows = df.withColumn("_text", F.when(F.coalesce(*unless).isNull(), description) if unless else description)
    rows = rows.withColumn("_place", keyword_place(F.col("_text"), rules))
    return rows.withColumn(name, keyword_result(F.col("_place"), rules)).drop("_text", "_place")


def category_texts(hierarchy: DataFrame) -> DataFrame:
    """One text per level-2 category: its names and those of its level-3 categories, in order."""
    rows = hierarchy.groupBy("l1_name", "l2_name", "unspsc_segment_code").agg(F.array_join(F.sort_array(F.collect_set("l3_name")), " ").alias("below"))
    return rows.withColumn("text", F.concat_ws(" ", "l1_name", "l2_name", "below"))


def decide_category(first: Column, second: Column, settings: Settings = DEFAULT) -> Column:
    """Confidence of the nearest category, less if the next is as near; null under the threshold."""
    close = (F.abs(first - second) <= settings.category_ambiguous) & (first > settings.category_ambiguous_above) & (second > settings.category_ambiguous_above)
    return F.when(first >= settings.category_similarity, F.when(F.coalesce(close, F.lit(False)), first * 0.75).otherwise(first * 0.9))


def by_vector(texts: DataFrame, categories: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``id``, ``by_vector`` for texts with vectors (``id``, ``vector``) against categories (``id``, ``vector``, ``l1``, ``l2``, ``unspsc``)."""
    near = match_vectors(texts, categories, top=2).groupBy("query_id")
    near = near.agg(F.max(F.when(F.col("rank") == 1, F.col("candidate_id"))).alias("id2"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("s2"))
    near = near.join(categories.select(F.col("id").alias("id2"), "l1", "l2", "unspsc"), "id2")
    confidence = decide_category(F.col("s1"), F.col("s2"), settings)
    found = F.when(confidence.isNotNull(), result(F.col("l1"), F.col("l2"), F.lit(None).cast("string"), F.col("unspsc"), confidence, "EMBEDDING"))
    return near.select(F.col("query_id").alias("id"), found.alias("by_vector"))


def capped(found: Column, most: float) -> Column:
    """A model's result with its confidence held down."""
    return F.when(found.isNotNull(), found.withField("confidence", F.least(found["confidence"], F.lit(most))))


def categorise(
    df: DataFrame,
    seeds: DataFrame,
    overrides: DataFrame,
    settings: Settings = DEFAULT,
    vectors: DataFrame | None = None,
    model: Callable[[DataFrame], DataFrame] | None = None,
    model_cap: float = 0.70,
    places: DataFrame | None = None,
) -> DataFrame:
    """Category columns by the first pass that has an answer. ``places``: see ``keyword_places``.

    ``vectors``: ``transaction_id`` and ``by_vector``. ``model`` gets the rows that are still open and returns
    ``transaction_id`` and ``by_model``; its confidence is capped. Rows without an answer keep null.
    """
    rules = rules_of(seeds, overrides)
    rows = by_override(df, None, rules=rules)
    rows = by_supplier(by_gl(rows, None, rules=rules), None, rules=rules)
    rows = by_keyword(rows, unless=("by_override", "by_gl", "by_supplier"), places=places)
    passes = ["by_override", "by_gl", "by_supplier", "by_keyword"]
    if vectors is not None:
        rows, passes = rows.join(vectors, "transaction_id", "left"), [*passes, "by_vector"]
    if model is not None:
        open_ = rows.where(F.coalesce(*passes).isNull()).select(*df.columns)
        rows = rows.join(model(open_).select("transaction_id", capped(F.col("by_model"), model_cap).alias("by_model")), "transaction_id", "left")
        passes = [*passes, "by_model"]
    # one column that the others are taken from, so that each row's passes are looked through once
    rows, found = rows.withColumn("_found", F.coalesce(*passes)), F.col("_found")
    out = {"category_l1": found["l1"], "category_l2": found["l2"], "category_l3": found["l3"], "unspsc_code": found["unspsc"], "category_confidence": found["confidence"], "category_method": found["method"]}
    return with_status(rows.withColumns(out).drop("_found", *passes), settings)


def with_status(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """State and flags that follow from method and confidence."""
    sure = F.coalesce(F.col("category_confidence"), F.lit(0.0)) >= settings.confidence_medium
    return df.withColumns({
        "categorisation_status": F.when(sure, "categorised").otherwise("review_required"),
        "ai_classification_flag": F.coalesce((F.col("category_method") == "LLM").cast("int"), F.lit(0)),
        "manual_override_flag": F.coalesce((F.col("category_method") == "MANUAL").cast("int"), F.lit(0)),
    })
