"""Positions in a total order, without a window over all rows.

Rows are dealt by ranges of the order, so each partition holds a stretch of it. A row's place in its stretch is known there;
what lies before the stretch is a sum over one count per stretch and group. No task sees more than its own range, whatever
the size of a group.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from enrichflow.sources.scratch import written

_PLACE_BITS = 33  # monotonically_increasing_id holds the partition above the row's place in it


def ranked(frame: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank", tie: Column | None = None) -> DataFrame:
    """The rows with their position (from 0) in ``order``, counted within each group of ``by``.

    Null groups are groups of their own. Rows that are equal in ``order`` get different positions; ``tie`` (by default a hash
    of all columns that can be hashed) decides between them and spreads many equal rows over several ranges.
    """
    by = list(by)
    plain = [c for c, kind in frame.dtypes if "map<" not in kind and "variant" not in kind]
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    spread = F.coalesce(tie, F.lit(0)) if tie is not None else F.xxhash64(*plain)
    dealt = frame.withColumn("_spread", spread)
    keys = keys + [F.col("_spread")]
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).drop("_spread")
    stored = written(dealt).withColumns({"_part": F.shiftright("_id", _PLACE_BITS), "_at": F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)})
    counts = stored.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    bases = written(bases).withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(by)} | {"_part": "_range"})
    same = F.col("_part") == F.col("_range")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    out = stored.join(bases, same).withColumn(name, F.col("_at") + F.col("_base"))
    return out.select(*frame.columns, name)
