"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

A candidate alone says little: the key of a tutorial stands in hundreds of repositories,
a leaked one with its owner only. So the hashes of all candidates are counted by distinct
repositories and owners over the whole corpus. Owners alone decide about a place: a key that
stands in thousands of documents of one owner counts as live, never as copied. The count of
repositories stands beside it in each span, for those who want to judge by it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.llm.common import spread_join, stored

# Fixed values of the base scan, in the order in which kinds are listed: pattern, the group that counts, its fewest characters.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
#: Bare candidates: runs with a digit; they become spans only by what the corpus says about their owners.
BARE = {"bare": (r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}", 0, 20)}
KINDS = [*BASE, *BARE]
#: Values in which these stand are examples.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|test|123456|abcdef"


def _steps(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of one kind: the length of what stands before each and of the match itself.

    The pieces between the matches and the matches follow each other, so that places are running sums of the lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    lengths = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))

    def step(x: Column, v: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), x["gap"].alias("gap"), x["size"].alias("size"), F.md5(v.cast("binary")).alias("print"), _live(v).alias("live"), (F.length(v) >= least).alias("enough"))

    none = F.expr("cast(array() as array<struct<rank:int,gap:int,size:int,print:string,live:boolean,enough:boolean>>)")
    return F.when(text.rlike(pattern), F.zip_with(lengths, value, step)).otherwise(none)


def _live(value: Column) -> Column:
    """Looks like a credential: letters and digits, at least eight different characters, no word of an example."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~value.rlike(PLACEHOLDER)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
    widely: int = 3,
) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``spans`` (arrays of start, rank, end, live, owners, repositories), ``n_live``, ``n_copied``.

    ``base`` are the spans of the three base kinds. ``spans`` adds bare candidates (no key word in
    front, in no base span) that look live and belong to one owner. ``n_live`` counts the spans that look live and
    have fewer than ``widely`` owners; ``n_copied`` those of values with at least ``widely`` owners, however many
    repositories (by default documents) they stand in. Owners and
    repositories are distinct non-null values over the whole corpus; a value without any owner
    counts as owned by one. Null and empty texts have no spans. Repeated rows are rows of their own and add no
    owner or repository. Values never leave the tasks: hashes stand for them. Other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[_steps(F.col("text"), k, *how) for k, how in (BASE | BARE).items()])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(repository_col).alias("repository"), F.col(owner_col).alias("owner"), text.alias("text"))
    rows = rows.select("doc_id", "repository", "owner", F.monotonically_increasing_id().alias("row"), found.alias("steps"))
    rows = stored(spark, rows, "steps")
    bare = KINDS.index("bare")
    places = rows.where(F.size("steps") > 0).select("row", "repository", "owner", F.posexplode("steps").alias("i", "step")).select("row", "repository", "owner", "i", "step.*")
    until = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    places = places.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(until).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    places = places.where("enough").where(f"rank < {bare} or live")
    # a bare span is apart from the base spans if none that starts by its start ends behind it, and none starts inside it
    base_end, base_start = F.when(F.col("rank") < bare, F.col("end")), F.when(F.col("rank") < bare, F.col("start"))
    forward = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    places = places.withColumns({"reached": F.max(base_end).over(forward), "next": F.min(base_start).over(backward)})
    apart = (F.coalesce("reached", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    places = stored(spark, places.select("row", "repository", "owner", "start", "rank", "end", "print", "live", apart.alias("apart")), "places")
    owned = places.select("print", "repository", "owner").distinct()
    owned = owned.groupBy("print").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))
    owned = stored(spark, owned.join(places.groupBy("print").agg(F.count(F.lit(1)).alias("uses")), "print"), "owned", narrow=True)
    judged = spread_join(places.drop("repository", "owner"), owned, "print", "uses", ["row", "start"])
    judged = judged.where(f"rank < {bare} or owners <= 1 and apart")
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "live", "owners", "repositories"))).alias("spans"))
    out = rows.select("doc_id", "row").join(judged, "row", "left")
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,live:boolean,owners:bigint,repositories:bigint>>)")
    out = out.select("doc_id", F.coalesce("spans", none).alias("spans")).withColumn("base", F.filter("spans", lambda s: s["rank"] < bare))
    return out.select(
        "doc_id",
        "base",
        "spans",
        F.size(F.filter("spans", lambda s: s["live"] & (s["owners"] < widely))).alias("n_live"),
        F.size(F.filter("spans", lambda s: s["owners"] >= widely)).alias("n_copied"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The spans as text and counts."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_copied")
