"""Chat formatting as prefix trees.

Conversations that share their first turns share those turns' tokens: each distinct prefix is
a node, emitted once, in depth-first order of its tree. A token is a code point of the
formatted text; a node has the place of its tokens in the tree's sequence, the position ids
they take (those of a conversation formatted alone) and the intervals of the sequence that
they may attend to: its ancestors' and, causally, its own.

Depth-first order comes from sorting the conversations by their turns: a conversation adds
exactly the turns behind what it shares with the one sorted before it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.llm.common import spread_join, stored

START, END = "<|im_start|>", "<|im_end|>\n"
# Strings that mark structure in this or other common templates; inside texts they are escaped.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = "|".join(r"\Q" + c[0] + r"\E(?=\Q" + c[1:] + r"\E)" for c in CONTROL)


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one is put behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_CONTROL})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """As ``escape``, and a new line, which ends a role, gets a backslash in front."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def head(role: Column) -> Column:
    return F.concat(F.lit(START), escaped_role(role), F.lit("\n"))


def _chain(hashes: pa.Array, sizes: pa.Array) -> pa.Array:
    """Of each conversation: the ids of all its prefixes, and where each turn starts; one start more, the end."""
    ids, starts = [], []
    for turns, lengths in zip(hashes.to_pylist(), sizes.to_pylist(), strict=True):
        at, chain, place = b"", [], [0]
        for h, n in zip(turns, lengths, strict=True):
            at = hashlib.blake2b(at + h.encode(), digest_size=16).digest()
            chain.append(at.hex())
            place.append(place[-1] + n)
        ids.append(chain)
        starts.append(place)
    return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64()))], names=["ids", "starts"])


def _common(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    apart = F.array_position(same, F.lit(False))
    return F.when(apart > 0, apart - 1).otherwise(n).cast("int")


def _counted(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``one`` (a row a key), stored, with ``uses``: how many rows of ``many`` have its key."""
    uses = many.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return stored(one.sparkSession, one.join(uses, key), "counted")


def pack(
    spark: SparkSession,
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained: tuple[str, ...] = ("assistant",),
) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of all conversations.

    ``nodes``, one row per distinct prefix: ``node``, ``tree`` (id of its first turn), ``parent`` (null at a
    root), ``depth``, ``first`` and ``end`` (its place in the tree's sequence, in tokens), ``position`` (position id
    of its first token), ``formatted``, ``loss_first`` and ``loss_end`` (the tokens of ``formatted`` under the
    loss mask; equal if none).
    ``paths``, one row per conversation: ``conv_id``, ``tree``, ``nodes`` (from the root on), ``attends`` (the
    intervals of the tree's sequence that its last token sees, in order, neighbours joined).

    Turns are ordered by ``turn_col``, ties by role and text, null turns first; null roles and
    texts are empty. Repeated rows are turns of their own. Rows with a null id are one conversation. Other
    columns play no part; an empty table gives empty results. A conversation is one row, however many turns it has.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    # two hashes, so that text can't move between role and text
    turns = turns.withColumn("hash", F.sha2(F.concat(F.sha2(F.col("role").cast("binary"), 256), F.col("text")).cast("binary"), 256))
    turns = turns.withColumn("size", F.length(head(F.col("role"))) + F.length(escape(F.col("text"))) + len(END))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "hash", "size"))).alias("turns"))
    chain = F.arrow_udf(_chain, "struct<ids:array<string>,starts:array<bigint>>")
    turns = turns.withColumn("chain", chain(F.col("turns.hash"), F.col("turns.size")))
    turns = stored(spark, turns.select("conv_id", "turns", "chain.ids", "chain.starts"), "chains")

    # equal conversations add nothing: one stands for all
    distinct = turns.groupBy(F.element_at("ids", -1).alias("leaf")).agg(F.min_by(F.struct("turns", "ids", "starts"), F.struct("conv_id")).alias("c")).select("leaf", "c.*")
    distinct = distinct.withColumn("hashes", F.col("turns.hash"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(spark, distinct.repartitionByRange(ranges, "hashes").withColumn("part", F.spark_partition_id()), "sorted")
    # one row a range: what stands before its first conversation
    over_parts = Window.orderBy("part")
    bounds = dealt.groupBy("part").agg(F.max("hashes").alias("highest")).select("part", F.lag("highest").over(over_parts).alias("behind"))
    inside = Window.partitionBy("part").orderBy("hashes")
    added = dealt.withColumn("previous", F.lag("hashes").over(inside)).join(F.broadcast(bounds), "part")
    previous = F.coalesce("previous", "behind", F.expr("cast(array() as array<string>)"))
    added = added.withColumn("shared", _common(F.col("hashes"), previous)).drop("previous", "behind", "hashes")
    at = lambda i: F.get("starts", i)
    added = stored(spark, added.withColumn("new", at(F.size("turns")) - at(F.col("shared"))), "added")
    # tokens of the trees before, and before those, where the tree starts
    order = Window.partitionBy("part").orderBy(F.col("turns.hash"))
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = added.groupBy("part").agg(F.sum("new").alias("n")).select("part", F.coalesce(F.sum("n").over(over_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = added.join(F.broadcast(sums), "part").withColumn("before", F.col("base") + F.coalesce(F.sum("new").over(until), F.lit(0)))
    placed = stored(spark, placed.withColumn("root_at", F.when(F.col("shared") == 0, F.col("before"))), "placed")
    roots = placed.groupBy("part").agg(F.max("root_at").alias("n")).select("part", F.max("n").over(over_parts.rowsBetween(Window.unboundedPreceding, -1)).alias("open_root"))
    placed = placed.join(F.broadcast(roots), "part").withColumn("root_at", F.coalesce(F.max("root_at").over(order.rowsBetween(Window.unboundedPreceding, 0)), "open_root"))

    # each conversation emits the nodes that the one before it lacks
    i = F.col("i")
    nodes = placed.select("turns", "ids", "starts", "shared", "before", "root_at", F.explode(F.sequence(F.col("shared"), F.size("turns") - 1)).alias("i"))
    turn = F.get("turns", i)
    first = F.col("before") - F.col("root_at") + at(i) - at(F.col("shared"))
    nodes = nodes.select(F.get("ids", i).alias("node"), F.get("ids", F.lit(0)).alias("tree"), F.when(i > 0, F.get("ids", i - 1)).alias("parent"), i.alias("depth"), first.alias("first"), (first + at(i + 1) - at(i)).alias("end"), at(i).alias("position"), turn["role"].alias("role"), turn["text"].alias("text"))
    opened = F.length(head(F.col("role")))
    closed = opened + F.when(F.col("role").isin(*trained), F.length(escape(F.col("text")))).otherwise(0)
    formatted = F.concat(head(F.col("role")), escape(F.col("text")), F.lit(END))
    nodes = stored(spark, nodes.select("node", "tree", "parent", "depth", "first", "end", "position", formatted.alias("formatted"), opened.alias("loss_first"), closed.alias("loss_end")), "nodes")

    # a first turn that all conversations share is one node of all of them
    seen = distinct.select("leaf", F.explode("ids").alias("node"))
    seen = spread_join(seen, _counted(seen, nodes.select("node", "first", "end"), "node"), "node", "uses", ["leaf"])
    seen = seen.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("seen"))
    none = F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), x["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == x["first"]), longer).otherwise(F.concat(acc, F.array(x)))

    seen = seen.select("leaf", F.aggregate("seen", none, join).alias("attends"))
    paths = turns.select("conv_id", F.col("ids").alias("nodes"), F.element_at("ids", -1).alias("leaf"))
    paths = spread_join(paths, _counted(paths, seen, "leaf"), "leaf", "uses", ["conv_id"])
    return nodes, paths.select("conv_id", F.get("nodes", F.lit(0)).alias("tree"), "nodes", "attends")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """From the packed form: ``conv_id``, ``turns`` (role and text of each), ``formatted`` and ``loss`` (all text under the mask, unescaped)."""
    steps = paths.select("conv_id", F.posexplode("nodes").alias("i", "node"))
    steps = spread_join(steps, _counted(steps, nodes.select("node", "formatted", "loss_first", "loss_end"), "node"), "node", "uses", ["conv_id", "i"])
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_first") + 1, F.col("loss_end") - F.col("loss_first")))
    steps = steps.select("conv_id", F.struct("i", "formatted", loss.alias("loss")).alias("step"))
    out = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    out = out.select("conv_id", F.array_join("steps.formatted", "").alias("formatted"), F.array_join("steps.loss", "").alias("loss"))
    parts = F.split("formatted", r"\Q" + END + r"\E", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    turn_pattern = (r"(?s)^\Q" + START + r"\E((?:[^\\\n]|\\.)*+)\n(.*)$")
    turns = F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, turn_pattern, 1)).alias("role"), unescape(F.regexp_extract(p, turn_pattern, 2)).alias("text")))
    return out.select("conv_id", turns.alias("turns"), "formatted", "loss")


def digest(read: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
