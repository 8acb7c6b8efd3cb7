"""Mix sources to target weights by pivotal dependent rounding.

A source's rate is its target over its words; each of its documents is taken ``floor(rate)`` times for certain and once more
with the rate's fractional part as probability. These probabilities are settled in pairs: two documents exchange an expected
number of words, at random and fairly, until one of the two probabilities is 0 or 1; the other one goes on to the next pair. No exchange
changes the expected words of the source, so the mix misses its target by less than one document at the end.

Documents are dealt into blocks of about ``BLOCK`` of one source and settled from the longest to the shortest, so that
partners are alike. Each block leaves at most one open document. Blocks of open documents are combined in the same way, ``BLOCK`` at
a time, until a source has one, which is rounded at random. That last block alone is drawn again, ``TRIES`` times at most, while
the source misses its target by more than ``CLOSE``. A source with a third of all rows is many blocks.

Draws depend on the seed, source, level and block, and the order in a block on what is dealt, so reruns agree. A document
without words (null and empty texts) takes 0. A null source is a source, last in order. Every row is a document of its own,
also without ``doc_id`` or repeated. Other columns are ignored. An empty table gives no rows.
"""
from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from enrichflow.llm.words import pieces
from enrichflow.operators.ranking import ranked
from enrichflow.sources.scratch import written

WEIGHTS, LIMIT, BLOCK, TRIES, CLOSE = (1, 2, 3), 3, 1000, 64, 0.005
SIZES = "doc_id bigint, source string, salt bigint, size bigint"
SETTLED = ("doc_id bigint, source string, place bigint, block bigint, salt bigint, size bigint, source_size bigint, target double, base bigint, part double, "
           "settled boolean")
_ALMOST = 1e-12


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, salt, size): the words of every row; ``salt`` spreads rows that have no id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in pieces(batches):
            yield pa.record_batch({"doc_id": part.column("doc_id"), "source": part.column("source"), "salt": part.column("salt"),
                                   "size": words.counts.astype(np.int64)})

    return docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("salt"), "text").mapInArrow(rows, SIZES)


def targets(sources: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Sources with their ``target``: shares of all words by ``weight``, none above ``limit`` times its words.

    Each round settles the sources whose share is too large and shares what is left among the others; a round reads one row
    of sums. Once no source is above its limit, the shares stand.
    """
    sources = sources.withColumn("cap", limit * F.col("source_size"))
    full, level = F.lit(False), None
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    seen = -1
    while True:
        at = sources.withColumn("full", full).agg(
            F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)).alias("open"),
            F.count_if(F.col("full")).alias("n")).first()
        if at["n"] == seen or not at["open"]:
            break
        seen, level = at["n"], max(0.0, total - at["given"]) / at["open"]
        full = full | (level * F.col("weight") > F.col("cap"))
    return sources.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(F.lit(level or 0.0) * F.col("weight"))).drop("cap")


def pivot(size: Sequence[int], part: Sequence[float], draw: random.Random) -> tuple[list[float], int]:
    """Settle fractions one pair after the other: the fractions, all but one of them 0 or 1, and the open one's place (-1: none)."""
    part, open_ = list(part), -1
    for at, (own, p) in enumerate(zip(size, part)):
        if not own or not _ALMOST < p < 1 - _ALMOST:
            part[at] = float(round(p)) if own else 0.0
            continue
        if open_ < 0:
            open_ = at
            continue
        other, q = size[open_], part[open_]
        up, down = min(other * (1 - q), own * p), min(other * q, own * (1 - p))
        moved = up if draw.random() * (up + down) < down else -down
        q, p = q + moved / other, p - moved / own
        if _ALMOST < q < 1 - _ALMOST:
            part[at], part[open_] = float(round(p)), q
        else:
            part[open_] = float(round(q))
            part[at] = p if _ALMOST < p < 1 - _ALMOST else float(round(p))
            open_ = at if part[at] == p and 0 < p < 1 else -1
    return part, open_


def _settle(table: pa.Table, seed: int, level: int) -> pa.Table:
    """One block: all documents settled but at most one; the last block of a source settles that one too."""
    table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("salt", "ascending")])
    size, part = table["size"].to_pylist(), table["part"].to_pylist()
    place, block, last = table["place"][0].as_py(), table["block"][0].as_py(), table["last"][0].as_py()
    target = table["target"][0].as_py()
    best = None
    for attempt in range(TRIES if last else 1):
        draw = random.Random(f"{seed}/{place}/{level}/{block}/{attempt}")
        out, open_ = pivot(size, part, draw)
        missed = 0.0
        if last and open_ >= 0:
            rounded = float(draw.random() < out[open_])
            missed += size[open_] * (rounded - out[open_])
            out[open_], open_ = rounded, -1
        if best is None or abs(missed) < abs(best[0]):
            best = (missed, out, open_)
        if abs(best[0]) <= CLOSE * target:
            break
    _, out, open_ = best
    settled = np.ones(len(out), bool)
    if open_ >= 0:
        settled[open_] = False
    return table.select(["doc_id", "source", "place", "block", "salt", "size", "source_size", "target", "base"]).append_column(
        "part", pa.array(out, pa.float64())).append_column("settled", pa.array(settled))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies and ``taken``, the words of all copies."""
    known = written(sizes(docs))
    sources = known.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    sources = ranked(sources, [F.col("source").asc_nulls_last()], name="place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(targets(written(sources.withColumn("weight", weight)), limit))
    rate = F.least(F.lit(float(limit)), F.col("target") / F.col("source_size"))
    own = sources.withColumn("rate", F.when(F.col("source_size") > 0, rate).otherwise(0.0)).select(
        F.col("source").alias("of"), "place", "source_size", "target", F.floor("rate").cast("bigint").alias("base"),
        (F.col("rate") - F.floor("rate")).alias("part"), F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("bigint").alias("blocks"))
    rows = known.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    open_rows = written(rows.withColumn("block", F.pmod("salt", "blocks")).filter("size > 0 AND part > 0"))
    done = [rows.filter("size = 0 OR part = 0").select("doc_id", "source", "size", "source_size", "target", "base", F.lit(0.0).alias("part"))]
    most, level = own.agg(F.max("blocks")).first()[0] or 0, 0
    while most:
        now = open_rows.withColumn("last", F.col("blocks") == 1)
        tried = level
        settled = written(now.groupBy("place", "block").applyInArrow(lambda table: _settle(table, seed, tried), SETTLED))
        done.append(settled.filter("settled").select("doc_id", "source", "size", "source_size", "target", "base", "part"))
        if most == 1:
            break
        fewer = own.select(F.col("place").alias("of"), F.ceil(F.col("blocks") / F.lit(block) ** (level + 1)).cast("bigint").alias("blocks"))
        open_rows = written(settled.filter("NOT settled").withColumn("block", F.floor(F.col("block") / block).cast("bigint"))
                            .join(fewer, F.col("place") == F.col("of")).drop("of", "settled"))
        most, level = -(-most // block), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("base") + F.col("part").cast("bigint")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
