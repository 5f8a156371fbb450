"""Supplier resolution: from raw names to canonical suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.config import DEFAULT, Settings
from outlay.functions import numbers, text
from outlay.operators import similar
from outlay.operators.joins import look_up, shuffled
from outlay.sources.scratch import stored


def distinct_names(df: DataFrame, position: str | None = None) -> DataFrame:
    """One row per raw name (the first in ``position``): name, id, normalised name, group size."""
    rows = df.where(F.col("raw_supplier_name").isNotNull())
    if position:
        names = rows.groupBy("raw_supplier_name").agg(F.min_by("raw_supplier_id", position).alias("raw_supplier_id"), F.min(position).alias("seen"))
    else:
        # the least of texts is found by sorting; so all rows are made distinct first, by hashing, and stored, as a least value needs no distinct rows and Spark would leave that step out
        pairs = stored(rows.select("raw_supplier_name", "raw_supplier_id").distinct(), "pairs", narrow=True)
        names = pairs.groupBy("raw_supplier_name").agg(F.min("raw_supplier_id").alias("raw_supplier_id")).withColumn("seen", F.col("raw_supplier_name"))
    # stored, as conditions on the normalised name would else be moved before the grouping and normalise each row's name
    names = stored(names, "raw-names", narrow=True).where(text.strip(F.col("raw_supplier_name")) != "")
    names = names.withColumn("normalised_name", text.normalise_name(F.col("raw_supplier_name")))
    names = stored(names, "names", narrow=True)
    sizes = names.groupBy("normalised_name").agg(F.count(F.lit(1)).alias("group_size"))
    return names.join(shuffled(sizes), "normalised_name").select("raw_supplier_name", "raw_supplier_id", "normalised_name", "group_size", "seen")


def build_master(names: DataFrame) -> DataFrame:
    """One row per normalised name: id, the first seen name in title case, vendor ids as JSON."""
    rows = names.where(F.col("normalised_name") != "").groupBy("normalised_name")
    rows = rows.agg(F.min_by("raw_supplier_name", F.struct("seen", "raw_supplier_name")).alias("first"), F.sort_array(F.collect_set("raw_supplier_id")).alias("raw_ids"))
    return rows.select(
        text.canonical_id(F.col("normalised_name")).alias("canonical_supplier_id"), text.title_case(text.strip(F.col("first"))).alias("canonical_name"), "normalised_name",
        F.lit(None).cast("string").alias("parent_company_id"), F.lit(None).cast("string").alias("parent_name"), F.to_json(F.struct("raw_ids")).alias("identifiers"),
    )


def vendor_ids(master: DataFrame) -> DataFrame:
    """Vendor id to supplier, from the master's JSON; unreadable JSON gives none, of repeated ids the last supplier counts."""
    ids = master.select("canonical_supplier_id", F.explode(F.from_json("identifiers", "raw_ids array<string>")["raw_ids"]).alias("raw_supplier_id"))
    return ids.where(F.col("raw_supplier_id").isNotNull() & (F.col("raw_supplier_id") != "")).groupBy("raw_supplier_id").agg(F.max("canonical_supplier_id").alias("vendor_match"))


def decide_fuzzy(score: Column, boost: Column, settings: Settings = DEFAULT) -> Column:
    """(method, confidence): the boost, in points, counts for the thresholds only."""
    points = score * 100 + boost
    return F.struct(
        F.when(points >= settings.fuzzy_auto, "FUZZY_AUTO").when(points >= settings.fuzzy_review, "FUZZY_REVIEW").otherwise("FUZZY_REJECT").alias("method"),
        F.when(points >= settings.fuzzy_auto, score * 0.95).when(points >= settings.fuzzy_review, score * 0.85).otherwise(score).alias("confidence"),
    )


def corroboration(same_city: Column, same_postcode: Column, same_abn: Column, settings: Settings = DEFAULT) -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(same_city, settings.same_city) + points(same_postcode, settings.same_postcode) + points(same_abn, settings.same_abn)



def match_fuzzy(names: DataFrame, master: DataFrame, settings: Settings = DEFAULT, boosts: DataFrame | None = None, rejected: bool = True) -> DataFrame:
    """The best supplier of each name by the composite score, of equals the first by name, then id: ``fuzzy_id``, ``fuzzy_score``, ``fuzzy`` (method, confidence).

    Names meet the suppliers that ``similar`` can't rule out at the review threshold. With ``rejected``, names that none reaches
    are compared a second time, without a threshold, so that each name has a row unless no supplier has a name; without
    it they have none. Null names have none. ``boosts`` (``normalised_name``, ``canonical_supplier_id``, ``boost``: points, see ``corroboration``) raise
    pairs over the thresholds; they don't choose the supplier.
    """
    own = stored(names.select(F.col("normalised_name").alias("name")).where(F.col("name").isNotNull()).distinct(), "names")
    known = master.select(F.col("normalised_name").alias("candidate"), "canonical_supplier_id").where(F.col("candidate") != "")
    known = stored(known.groupBy("candidate").agg(F.min("canonical_supplier_id").alias("canonical_supplier_id")), "suppliers")
    if known.isEmpty():
        return names.sparkSession.createDataFrame([], "normalised_name string, fuzzy_id string, fuzzy_score double, fuzzy struct<method:string,confidence:double>")
    cells, least = similar.cells_of(known), settings.fuzzy_review / 100
    near = stored(similar.first_of(similar.near(own, known, least)), "near")
    raised = stored(own.join(shuffled(near.select("name", F.col("score").alias("floor"))), "name", "left").withColumn("floor", F.coalesce("floor", F.lit(least))), "floors")
    found = similar.by_letters(raised, known, cells, least).unionByName(similar.by_words(raised, known, least)).unionByName(near)
    best = stored(similar.first_of(found), "best")
    if rejected or boosts is not None:
        best = best.unionByName(similar.first_of(similar.by_letters(stored(own.join(shuffled(best), "name", "left_anti"), "rest"), known, cells, 0.0)))
    best = best.select(F.col("name").alias("normalised_name"), F.col("supplier.canonical_supplier_id").alias("fuzzy_id"), F.col("score").alias("fuzzy_score"))
    boost = F.lit(0)
    if boosts is not None:
        one = boosts.groupBy("normalised_name", F.col("canonical_supplier_id").alias("fuzzy_id")).agg(F.max("boost").alias("boost"))
        best, boost = best.join(shuffled(one), ["normalised_name", "fuzzy_id"], "left"), F.coalesce("boost", F.lit(0))
    return best.select("normalised_name", "fuzzy_id", "fuzzy_score", decide_fuzzy(F.col("fuzzy_score"), boost, settings).alias("fuzzy"))


def decide_vector(similarity: Column, settings: Settings = DEFAULT) -> Column:
    return F.struct(
        F.when(similarity >= settings.vector_auto, "EMBEDDING_AUTO").when(similarity >= settings.vector_review, "EMBEDDING_REVIEW").otherwise("EMBEDDING_REJECT").alias("method"),
        F.when(similarity >= settings.vector_auto, similarity * 0.95).when(similarity >= settings.vector_review, similarity * 0.85).otherwise(similarity).alias("confidence"),
    )


def harmonise(df: DataFrame, master: DataFrame, settings: Settings = DEFAULT, vectors: DataFrame | None = None, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(master with new suppliers, match log with a row per raw name).

    In turn: several raw names with one normalised name 1.0; a name that the master has 0.95; a vendor id
    0.99; fuzzy; ``vectors`` (``normalised_name``, ``vector_id``, ``similarity``), if given; a new supplier 1.0. Under
    the review threshold a match waits for review. Names that no supplier reaches at the fuzzy review threshold have no fuzzy score.
    """
    names = distinct_names(df, position)
    known = master.select("normalised_name", F.lit(True).alias("_known")).distinct()
    rows = names.join(shuffled(known), "normalised_name", "left").join(shuffled(vendor_ids(master)), "raw_supplier_id", "left")
    cheap = (F.col("group_size") > 1) | F.coalesce("_known", F.lit(False)) | F.col("vendor_match").isNotNull()
    rows = rows.join(shuffled(match_fuzzy(rows.where(~cheap), master, settings, rejected=False)), "normalised_name", "left")
    if vectors is None:
        rows = rows.withColumns({"vector_id": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")})
    else:
        rows = rows.join(shuffled(vectors), "normalised_name", "left")
    own = text.canonical_id(F.col("normalised_name"))
    vector = decide_vector(F.col("similarity"), settings)
    result = lambda id_, method, confidence: F.struct(id_.alias("id"), method.alias("method"), confidence.cast("double").alias("confidence"))
    found = (
        F.when(F.col("group_size") > 1, result(own, F.lit("NORMALISED_NAME_GROUP"), F.lit(1.0)))
        .when(F.col("_known"), result(own, F.lit("EXACT_NORMALISED_NAME"), F.lit(0.95)))
        .when(F.col("vendor_match").isNotNull(), result(F.col("vendor_match"), F.lit("EXACT_VENDOR_ID"), F.lit(0.99)))
        .when(F.col("fuzzy.method") != "FUZZY_REJECT", result(F.col("fuzzy_id"), F.col("fuzzy.method"), F.col("fuzzy.confidence")))
        .when(vector["method"] != "EMBEDDING_REJECT", result(F.col("vector_id"), vector["method"], vector["confidence"]))
        .otherwise(result(own, F.lit("NEW_CANONICAL"), F.lit(1.0)))
    )
    log = rows.withColumn("found", found).select(
        "raw_supplier_name", "raw_supplier_id", F.col("found.id").alias("canonical_supplier_id"), F.col("found.method").alias("match_method"), F.round("found.confidence", 6).alias("confidence"),
        F.to_json(F.struct("normalised_name", "group_size", F.round("fuzzy_score", 4).alias("fuzzy"))).alias("evidence"),
        F.when(F.col("found.confidence") < settings.supplier_review_below, "PENDING").otherwise("APPROVED").alias("review_status"),
    )
    fresh = build_master(names).join(shuffled(master.select("canonical_supplier_id")), "canonical_supplier_id", "left_anti")
    return master.unionByName(fresh.select(*master.columns)), log


def attach_suppliers(df: DataFrame, log: DataFrame, master: DataFrame) -> DataFrame:
    """Supplier columns of the surest match of each raw name, in place of any that are there."""
    from outlay.operators.segments import first_by_confidence

    lookup = first_by_confidence(log).join(shuffled(master.select("canonical_supplier_id", "canonical_name", "parent_company_id", "parent_name")), "canonical_supplier_id", "left")
    lookup = lookup.select("raw_supplier_name", "canonical_supplier_id", F.col("canonical_name").alias("canonical_supplier_name"), F.col("confidence").alias("canonical_supplier_confidence"), "parent_company_id", F.col("parent_name").alias("parent_company_name"))
    return look_up(df.drop(*[c for c in lookup.columns if c != "raw_supplier_name"]), lookup, "raw_supplier_name")


def review_queue(log: DataFrame, master: DataFrame, df: DataFrame) -> DataFrame:
    """Matches that wait, with supplier name (its id if there is none) and spend, the least sure and largest first."""
    spend = df.groupBy("raw_supplier_name").agg(numbers.total(F.col("base_amount")).alias("spend"))
    rows = log.where(F.col("review_status") == "PENDING").join(master.select("canonical_supplier_id", "canonical_name"), "canonical_supplier_id", "left").join(spend, "raw_supplier_name", "left")
    rows = rows.withColumns({"supplier": F.coalesce("canonical_name", "canonical_supplier_id"), "spend": F.coalesce("spend", F.lit(0.0))}).drop("canonical_name")
    return rows.orderBy("confidence", F.desc("spend"), "raw_supplier_name")


def new_log_rows(log: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose name hasn't been logged."""
    return log.join(shuffled(existing.select("raw_supplier_name").distinct()), "raw_supplier_name", "left_anti")


def with_parents(master: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents (``supplier_name``, ``parent_company_name``) for suppliers of that name; others stay as they are."""
    found = parents.where(F.col("parent_company_name").isNotNull()).groupBy(F.col("supplier_name").alias("canonical_name")).agg(F.min("parent_company_name").alias("_parent"))
    rows = master.join(found, "canonical_name", "left")
    out = {"parent_company_id": F.coalesce(text.canonical_id(F.lower("_parent")), "parent_company_id"), "parent_name": F.coalesce("_parent", "parent_name")}
    return rows.withColumns(out).drop("_parent").select(*master.columns)


def related(df: DataFrame) -> DataFrame:
    """Suppliers with a parent that has others too, a row each, with the number of the others: a group's members are those of one parent."""
    one = df.where("parent_company_name is not null and canonical_supplier_name is not null").select("parent_company_name", "canonical_supplier_name").distinct()
    sizes = one.groupBy("parent_company_name").agg((F.count(F.lit(1)) - 1).alias("related"))
    return one.join(sizes.where("related > 0"), "parent_company_name")


def by_keys(store: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows (vectors of names, for instance) for a list of keys, in the list once or several times; keys that aren't stored have no row."""
    return store.join(keys.select(key).distinct(), key, "left_semi")


def with_normalised_name(master: DataFrame) -> DataFrame:
    """A stored master with ``normalised_name`` derived from the canonical name where it has none."""
    own = F.col("normalised_name") if "normalised_name" in master.columns else F.lit(None).cast("string")
    return master.withColumn("normalised_name", F.coalesce(own, text.normalise_name(F.col("canonical_name"))))
