"""Collapse cumulative conversation snapshots and render those that remain, with DataFrame functions only.

A log that stores a conversation after every turn holds each prefix again. Turns are numbered within their conversation, and
every turn gets a 128-bit rolling hash of the turns up to it. A conversation whose last hash is found before the end of
another one is a prefix of it and goes in an anti-join; of equal conversations the smallest ``conv_id`` stays.

The hash is the XOR of hashes of (number, role, text), so it is built in blocks of ``BLOCK`` turn numbers: a conversation that
holds a large part of all rows is numbered and hashed by many tasks, and only block totals meet. The output has one row for
each ``CHUNK`` turns of a kept conversation, so no task gathers a whole long one.

Rows without ``conv_id`` are left out. Exact repeats of a row count once. Rows with the same turn number are ordered by their
hash; a null turn comes first. A null role is rendered as ``unknown``, a null text as nothing, and ``<|`` in a text as
``<\\|``, so texts cannot fake a turn. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK, CHUNK = 256, 256
_FIRST = -(1 << 62)


def _hash(salt: int, *columns: str) -> Column:
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(salt), *parts)


def _turns(turns: DataFrame) -> DataFrame:
    """Distinct turns with two hashes of role and text."""
    kept = turns.filter("conv_id IS NOT NULL").select("conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(_FIRST)).alias("turn"), "role", "text")
    return kept.withColumn("h", _hash(1, "role", "text")).withColumn("k", _hash(2, "text", "role"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, h, k, n, p, q): each distinct turn, its number from 1 and the hashes (p, q) of the turns up to it."""
    rows = _turns(turns).groupBy("conv_id", "turn", "h", "k").agg(F.lit(1).alias("one"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "h", "k")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("n", F.row_number().over(inside))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    placed = placed.join(sizes, ["conv_id", "block"]).withColumn("n", F.col("n") + F.col("offset"))
    placed = placed.withColumn("g", F.xxhash64(F.lit(3), "n", "h", "k")).withColumn("m", F.xxhash64(F.lit(4), "k", "h", "n"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("p", F.bit_xor("g").over(upto)).withColumn("q", F.bit_xor("m").over(upto))
    totals = placed.groupBy("conv_id", "block").agg(F.bit_xor("g").alias("tp"), F.bit_xor("m").alias("tq"))
    totals = totals.select("conv_id", "block", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("tp", "tq")))
    return placed.join(totals, ["conv_id", "block"]).select(
        "conv_id", "turn", "h", "k", "n", F.col("p").bitwiseXOR(F.col("tp")).alias("p"), F.col("q").bitwiseXOR(F.col("tq")).alias("q"))


def _last(known: DataFrame) -> DataFrame:
    """(conv_id, n, p, q) of the last turn of each conversation."""
    return known.groupBy("conv_id").agg(F.max_by(F.struct("n", "p", "q"), "n").alias("last")).select("conv_id", "last.*")


def maximal(known: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that no longer one begins with; ``known`` are ``prefixes``."""
    ends = _last(known)
    alike = ends.groupBy("n", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = known.join(ends.select("conv_id", F.col("n").alias("size")), "conv_id").filter("n < size").select("n", "p", "q").distinct()
    return alike.join(inner, ["n", "p", "q"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, n_turns, n_copies, text): the kept conversations in the layout ``<|role|>\\ntext<|end|>\\n``."""
    known = prefixes(turns)
    kept = known.join(maximal(known), "conv_id").select("conv_id", "turn", "h", "k", "n", "n_turns", "n_copies")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"),
                    F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>\n"))
    said = _turns(turns).join(kept, ["conv_id", "turn", "h", "k"]).select(
        "conv_id", "n", "n_turns", "n_copies", F.floor((F.col("n") - 1) / CHUNK).alias("chunk"), line.alias("line"))
    grouped = said.groupBy("conv_id", "chunk", "n_turns", "n_copies").agg(F.array_sort(F.collect_set(F.struct("n", "line"))).alias("lines"))
    return grouped.select("conv_id", "chunk", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("text"))
