"""Whole runs, composed of the other operators: promotion, cube, savings, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay import reference, schema
from outlay.config import DEFAULT, Settings
from outlay.functions import dates, numbers, text
from outlay.operators import categorise, changes, cube, ingest, kpis, quality, recommend, segments, suppliers
from outlay.operators.joins import look_up
from outlay.sources import files
from outlay.sources.scratch import stored


@dataclass(frozen=True)
class Promotion:
    """The tables after a promotion, and its counts."""

    facts: DataFrame
    landing: DataFrame
    master: DataFrame
    log: DataFrame
    counts: DataFrame


def restored(landing: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Landed rows with the columns of their export again, cleaned and typed; what the landing table holds itself is kept."""
    mapping = mapping or reference.COLUMN_MAPPINGS["DEFAULT"]
    raw = F.from_json("raw_data", ", ".join(f"`{c}` string" for c in mapping))
    rows = landing.withColumn("_raw", raw)
    more = {into: F.col("_raw")[c] for c, into in mapping.items() if into not in landing.columns}
    typed = {"invoice_date": dates.parse_date(more.get("invoice_date", F.lit(None).cast("string"))), "original_amount": text.clean(more.get("original_amount", F.lit(None).cast("string"))).try_cast("double")}
    return ingest.clean(rows.withColumns(more | {c: v for c, v in typed.items() if c in more}).drop("_raw"))


def promote(
    landing: DataFrame,
    facts: DataFrame,
    master: DataFrame,
    log: DataFrame,
    seeds: DataFrame,
    overrides: DataFrame,
    engagement_id: str | None = None,
    batch_id: str | None = None,
    settings: Settings = DEFAULT,
) -> Promotion:
    """Queued rows get suppliers and categories; sure ones become facts, the others wait for review.

    ``facts`` needs the columns of ``schema.TRANSACTION_SCHEMA``. A row hash names its fact, so promoting
    again adds nothing. No model is asked. Without queued rows all tables stay and the counts are 0.
    The match log and the categorised rows are written once, as all results read them; facts are read from there, not written again.
    """
    queue = ingest.queued(landing, engagement_id, batch_id)
    rows = restored(queue).withColumn("transaction_id", F.col("source_row_hash"))
    # each name and description is cleaned and looked at once, not once a row with all that its row holds
    once = lambda *names: ingest.clean_texts(queue.select(*names).distinct()) if set(names) <= set(queue.columns) else rows.select(*names)
    grown, found = suppliers.harmonise(once("raw_supplier_name", "raw_supplier_id"), master, settings)
    places = categorise.keyword_places(once("raw_line_description"))
    grown, found = stored(grown, "master"), stored(found, "matches")
    rows = stored(categorise.categorise(suppliers.attach_suppliers(rows, found, grown), seeds, overrides, settings, places=places), "promotion")
    sure = rows.where("categorisation_status = 'categorised'")
    fields = schema.TRANSACTION_SCHEMA.fields
    new = sure.select(*[(F.col(f.name) if f.name in sure.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    new = ingest.absent_rows(new, facts)
    columns = [f.name for f in fields]
    # worked out only if the landing table is read; truth values are added up by hashing
    states = rows.groupBy("engagement_id", "source_row_hash").agg(F.bool_or(F.col("categorisation_status") == "categorised").alias("_sure"))
    state = F.when(F.col("_sure"), "processed").when(~F.col("_sure"), "review_required")
    queued = F.col("status") == "queued"
    marked = look_up(landing, states, ["engagement_id", "source_row_hash"], common=False, small=False).withColumn("status", F.when(queued, F.coalesce(state, F.col("status"))).otherwise(F.col("status")))
    counts = rows.agg(F.count_if(F.col("categorisation_status") == "categorised").alias("promoted"), F.count_if(F.col("categorisation_status") == "review_required").alias("review_required"))
    return Promotion(facts.select(*columns).unionByName(new), marked.select(*landing.columns), grown, log.unionByName(suppliers.new_log_rows(found, log).select(*log.columns)), counts)


def build(df: DataFrame, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """All tables of a cube run by name: its views, segments, key figures, checks and score.

    The views and what segments, tail and concentration begin with come from one pass over the transactions, checks and score from one table of checks.
    """
    views = cube.cube(df, "supplier_spend")
    spend = views.pop("supplier_spend")
    abc, checks = stored(segments.abc(df, spend=spend), "abc"), stored(quality.diagnose(df), "checks")
    flagged = segments.with_tail_flag(changes.set_segments(views["transactions"], abc), spend)
    return views | {"transactions": flagged, "abc": abc, "concentration": segments.concentration(df, spend), "kpis": kpis.kpis(df, settings), "diagnostics": checks, "scorecard": quality.scorecard_of(checks)}


def run(df: DataFrame, directory: str, settings: Settings = DEFAULT) -> None:
    """Writes each table of a cube run as Parquet and the checks as JSON too."""
    tables = build(df, settings)
    files.write_views(tables, directory)
    files.write_json(tables["diagnostics"], f"{directory}/diagnostics_json")


def whole(raw: DataFrame, rates: DataFrame, seeds: DataFrame, overrides: DataFrame, directory: str, engagement_id: str, settings: Settings = DEFAULT) -> tuple[Promotion, dict[str, DataFrame]]:
    """From an export to savings in one run over new tables: lands, promotes, writes the cube below ``directory``; the promotion and ``savings`` of its facts."""
    spark = raw.sparkSession
    empty = lambda fields: spark.createDataFrame([], fields)
    landed = stored(ingest.to_landing(ingest.ingest(raw, rates, engagement_id, settings=settings), "1"), "landed")
    done = promote(landed, empty(schema.TRANSACTION_SCHEMA), empty(schema.MASTER_SCHEMA), empty(schema.MATCH_LOG_SCHEMA), seeds, overrides, engagement_id, "1", settings)
    run(done.facts, directory, settings)
    return done, savings(done.facts, settings)


def savings(df: DataFrame, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """The recommendations that stay after allocation, and the portfolio that they make."""
    df = stored(recommend.cells(df), "cells")
    allocated = recommend.allocate(recommend.generate(df, settings))
    return {"recommendations": allocated, "portfolio": recommend.portfolio(allocated, df, settings), "levers": recommend.by_lever(allocated)}


# Where an evaluation passes and where it warns.
COVERAGE_GATES, COUNT_GATES = (0.70, 0.50), (3, 1)


def evaluate(df: DataFrame, portfolio: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of ``section``, ``metric``, ``value`` and ``verdict`` over transactions and their savings portfolio.

    Coverage of categories and the number of recommendations have gates; implausible savings fail. The verdict
    of the whole is FAIL if any is. An empty table has coverage 0. Metrics without a gate have no verdict.
    """
    sure = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    part = lambda c: numbers.half_even(numbers.ratio(F.count_if(c), F.count(F.lit(1))), 4)
    high, medium = settings.confidence_high, settings.confidence_medium
    bands = lambda c: {"high_pct": part(sure(c) >= high), "medium_pct": part((sure(c) >= medium) & (sure(c) < high)), "low_pct": part(sure(c) < medium)}
    metrics = {
        ("ingestion", "row_count"): F.count(F.lit(1)),
        ("ingestion", "credit_notes"): F.count_if(text.document_type(F.col("base_amount").cast("double"), F.col("invoice_number")) == "CREDIT_NOTE"),
        ("ingestion", "intercompany"): F.count_if(F.col("is_intercompany") == 1),
        ("harmonisation", "canonical_suppliers"): F.countDistinct("canonical_supplier_id"),
        ("harmonisation", "unmatched"): F.count_if(F.col("canonical_supplier_id").isNull()),
        ("categorisation", "coverage_pct"): part(sure("category_confidence") >= medium),
        ("categorisation", "uncategorised"): F.count_if(F.col("category_confidence").isNull()),
    } | {("categorisation", k): v for k, v in bands("category_confidence").items()}
    if "canonical_supplier_confidence" in df.columns:
        metrics |= {("harmonisation", k): v for k, v in bands("canonical_supplier_confidence").items()}
    one = df.agg(*[v.cast("double").alias(f"{s}.{m}") for (s, m), v in metrics.items()]).join(F.broadcast(portfolio))
    gate = lambda c, gates: F.when(c >= gates[0], "PASS").when(c >= gates[1], "WARN").otherwise("FAIL")
    coverage = gate(F.coalesce("`categorisation.coverage_pct`", F.lit(0.0)), COVERAGE_GATES)
    count = gate(F.col("recommendations"), COUNT_GATES)
    plausible = F.when(F.coalesce("plausible", F.lit(True)), "PASS").otherwise("FAIL")
    none = F.lit(None).cast("string")
    row = lambda section, metric, value, verdict=none: F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), verdict.alias("verdict"))
    rows = [row(s, m, F.coalesce(f"`{s}.{m}`", F.lit(0.0)), coverage if m == "coverage_pct" else none) for s, m in metrics]
    failed = (coverage == "FAIL") | (count == "FAIL") | (plausible == "FAIL")
    rows += [
        row("recommendations", "count", F.col("recommendations"), count),
        row("recommendations", "total_savings", F.col("total_savings")),
        row("recommendations", "savings_pct", F.coalesce("savings_pct", F.lit(0.0)), plausible),
        row("overall", "verdict", failed.cast("int"), F.when(failed, "FAIL").otherwise("PASS")),
    ]
    return one.select(F.inline(F.array(*rows)))
