"""Models as plug-ins: a task loads one, asks it in batches with a time limit and again after a failure, and whatever goes wrong becomes a row.

A model comes as a factory (a function without arguments that workers can import). Without one nothing is asked: categories are
a dry run, vectors and parents are left out. Answers are matched to their questions by id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.operators.categorise import result
from outlay.sources.scratch import stored

#: Rows that a model gets at once, how often it is asked, seconds it may take, and the most confidence its categories and parents have.
BATCH, ATTEMPTS, SECONDS = 20, 3, 60.0
CATEGORY_CAP, PARENT_CAP = 0.70, 0.50

Ask = Callable[[list[dict]], str]
Encode = Callable[[list[str]], list[list[float]]]


@lru_cache(4)
def loaded(make: Callable[[], Callable]) -> Callable:
    """A worker's one copy of a model."""
    return make()


def asked(model: Callable, question, attempts: int = ATTEMPTS, seconds: float = SECONDS):
    """The model's answer; raises what the last attempt raised."""
    for attempt in range(1, attempts + 1):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(model, question).result(seconds)
        except Exception:
            if attempt == attempts:
                raise
        finally:
            pool.shutdown(wait=False, cancel_futures=True)  # an answer that comes too late isn't waited for


def parsed(answer: str) -> list[dict]:
    """A model's JSON list, in a code fence or not; raises if it is none."""
    lines = answer.strip().splitlines()
    if lines and lines[0].startswith("```"):
        lines = lines[1:-1] if lines[-1].strip().startswith("```") else lines[1:]
    found = json.loads("\n".join(lines))
    if not isinstance(found, list):
        raise ValueError("not a list")
    return [x for x in found if isinstance(x, dict)]


def _answers(model: Callable, items: list[dict], key: str, attempts: int, seconds: float) -> list[dict]:
    """For each item the answer with its key, or one that only says what went wrong."""
    failed = lambda why: [{key: i[key], "reasoning": why} for i in items]
    try:
        answer = asked(model, items, attempts, seconds)
    except TimeoutError:
        return failed("no answer in time")
    except Exception as e:  # whatever a plug-in raises
        return failed(f"call failed: {e}")
    try:
        by_key = {str(x.get(key, "")): x for x in parsed(answer)}
    except ValueError as e:
        return failed(f"unreadable answer: {e}")
    return [by_key.get(str(i[key]), {key: i[key], "reasoning": "no answer for this row"}) | {key: i[key]} for i in items]


def _number(x: object) -> float:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0


def _text(x: object) -> str | None:
    return None if x is None else str(x)


def ask_each(rows: DataFrame, make: Callable[[], Ask], key: str, fields: dict[str, str], batch: int = BATCH, attempts: int = ATTEMPTS, seconds: float = SECONDS) -> DataFrame:
    """``rows`` in batches to a model; of each row its key and the answer's ``fields`` (name to ``string`` or ``double``), with ``reasoning``."""
    names = rows.columns
    kinds = {"string": (pa.string(), _text), "double": (pa.float64(), _number)}
    every = fields | {"reasoning": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            items = some.select(names).to_pylist()
            found = []
            for i in range(0, len(items), batch):
                found += _answers(loaded(make), items[i : i + batch], key, attempts, seconds)
            columns = [pa.array([kinds[kind][1](f.get(n)) for f in found], kinds[kind][0]) for n, kind in every.items()]
            yield pa.RecordBatch.from_arrays([some.column(names.index(key)), *columns], [key, *every])

    schema = T.StructType([rows.schema[key], *[T.StructField(n, T.StringType() if k == "string" else T.DoubleType()) for n, k in every.items()]])
    return rows.mapInArrow(run, schema)


ANSWER = {"internal_category_l1": "string", "internal_category_l2": "string", "internal_category_l3": "string", "unspsc_segment_code": "string", "confidence": "double"}


def classify(open_rows: DataFrame, make: Callable[[], Ask] | None = None, cap: float = CATEGORY_CAP, batch: int = BATCH, attempts: int = ATTEMPTS, seconds: float = SECONDS) -> DataFrame:
    """Of each row: ``transaction_id``, the answer's category, ``confidence`` (``cap`` at most), ``method`` and ``reasoning``.

    Without a model a dry run: confidence 0, method ``DRY_RUN``. A failed or missing answer has confidence 0 and says why. Null ids are asked too.
    """
    if make is None:
        none = F.lit(None).cast("string")
        return open_rows.select("transaction_id", *[none.alias(n) for n in ANSWER if n != "confidence"], F.lit(0.0).alias("confidence"), F.lit("DRY_RUN").alias("method"), none.alias("reasoning"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in open_rows.columns else F.lit("")
    items = open_rows.select("transaction_id", text("raw_line_description").alias("description"), text("canonical_supplier_name").alias("supplier_name"), text("gl_account").alias("gl_account"))
    found = ask_each(items, make, "transaction_id", ANSWER, batch, attempts, seconds)
    return found.withColumns({"confidence": F.least("confidence", F.lit(cap)), "method": F.lit("LLM")}).select("transaction_id", *ANSWER, "method", "reasoning")


def category_model(make: Callable[[], Ask] | None = None, **how) -> Callable[[DataFrame], DataFrame]:
    """A model for ``categorise``: answers with a level-1 category become ``by_model``."""

    def run(open_rows: DataFrame) -> DataFrame:
        c = F.col
        found = classify(open_rows, make, **how)
        answer = result(c("internal_category_l1"), c("internal_category_l2"), c("internal_category_l3"), c("unspsc_segment_code"), c("confidence"), "LLM")
        return found.select("transaction_id", F.when(c("internal_category_l1").isNotNull(), answer).alias("by_model"))

    return run


def encode(texts: DataFrame, store: DataFrame, make: Callable[[], Encode] | None = None, batch: int = 256, attempts: int = ATTEMPTS, seconds: float = SECONDS) -> tuple[DataFrame, DataFrame]:
    """(``text``, ``vector`` of each distinct text, the store with the new ones): only texts that the store lacks are encoded, each once.

    ``store`` has ``id`` (the text) and ``vector``. Without a model, and where it fails, texts that aren't stored have no row. Null texts have none.
    """
    wanted = texts.where(F.col("text").isNotNull()).select("text").distinct()
    known = store.select(F.col("id").alias("text"), F.col("vector").cast("array<double>").alias("vector"))
    if make is None:
        return wanted.join(known, "text"), store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            listed = some.column(0).to_pylist()
            for i in range(0, len(listed), batch):
                part = listed[i : i + batch]
                try:
                    vectors = asked(loaded(make), part, attempts, seconds)
                except Exception:  # whatever a plug-in raises: these texts stay without a vector
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], ["text", "vector"])

    new = stored(wanted.join(known, "text", "left_anti").mapInArrow(run, "text string, vector array<double>"), "vectors")
    kind = T.ArrayType(store.schema["vector"].dataType.elementType)
    grown = store.unionByName(new.select(F.col("text").alias("id"), F.col("vector").cast(kind).alias("vector"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema.fields if f.name not in ("id", "vector")]))
    return wanted.join(known.unionByName(new), "text"), grown


def parents(names: DataFrame, make: Callable[[], Ask] | None = None, cap: float = PARENT_CAP, batch: int = BATCH, attempts: int = ATTEMPTS, seconds: float = SECONDS) -> DataFrame:
    """``supplier_name``, ``parent_company_name``, ``confidence`` (``cap`` at most), ``method``, ``reasoning`` of each distinct name; a dry run without a model."""
    one = names.where(F.col("supplier_name").isNotNull()).select("supplier_name").distinct()
    if make is None:
        none = F.lit(None).cast("string")
        return one.select("supplier_name", none.alias("parent_company_name"), F.lit(0.0).alias("confidence"), F.lit("DRY_RUN").alias("method"), none.alias("reasoning"))
    found = ask_each(one, make, "supplier_name", {"parent_company_name": "string", "confidence": "double"}, batch, attempts, seconds)
    return found.withColumns({"confidence": F.least("confidence", F.lit(cap)), "method": F.lit("LLM")}).select("supplier_name", "parent_company_name", "confidence", "method", "reasoning")


def narratives(recommendations: DataFrame, make: Callable[[], Ask] | None = None, **how) -> DataFrame:
    """``recommendations`` (with ``type`` and ``context``) with ``narrative``; null without a model or an answer."""
    if make is None:
        return recommendations.withColumn("narrative", F.lit(None).cast("string"))
    keyed = recommendations.withColumn("narrative_key", F.concat_ws("|", "type", F.coalesce("context", F.lit(""))))
    questions = keyed.select("narrative_key").distinct()
    found = ask_each(questions, make, "narrative_key", {"narrative": "string"}, **how).drop("reasoning")
    return keyed.join(found, "narrative_key", "left").drop("narrative_key")
