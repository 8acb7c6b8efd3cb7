"""One row per key: first wins, last wins, versioned upsert, first-n cut-offs.

All reductions are aggregates with a map-side half, so a key holding a large share of the rows
shrinks to one row per input task before the shuffle.
"""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from enrichflow.fixed_values import COMPLETED

_SALTS = 256


def _payload(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(*(c for c in df.columns if c not in keys))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], copies: str | None = None) -> DataFrame:
    """Earliest row per key in ``order``; ``copies`` names a column counting all rows of the key."""
    aggregates = [F.min_by(_payload(df, keys), F.struct(*order)).alias("_row")]
    if copies:
        aggregates.append(F.count("*").alias(copies))
    extra = [copies] if copies else []
    return df.groupBy(*keys).agg(*aggregates).select(*keys, "_row.*", *extra)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key in ``order`` (append-log reading: the last line of a key wins)."""
    return (
        df.groupBy(*keys).agg(F.max_by(_payload(df, keys), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    )


def protected_latest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], status: str = "status", final: str = COMPLETED
) -> DataFrame:
    """Row-by-row upsert of a log: the first final row of a key stays, otherwise the last row wins.

    Equals applying ``upsert`` once per row in ``order`` but needs one pass and no existing table.
    """
    at = F.struct(*order)
    row = _payload(df, keys)
    return (
        df.groupBy(*keys)
        .agg(
            F.min_by(row, F.when(F.col(status) == final, at)).alias("_final"),
            F.max_by(row, at).alias("_last"),
        )
        .select(*keys, F.coalesce("_final", "_last").alias("_row"))
        .select(*keys, "_row.*")
    )


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: str = "ord",
    status: str = "status",
    final: str = COMPLETED,
) -> DataFrame:
    """Existing final rows never change, other existing rows are replaced in place, new keys are appended.

    Stored order is (``batch``, ``ord``): replaced rows keep theirs, appended rows take the next
    batch number and the position where the key first appears. Column ``accepted`` holds the number
    of incoming rows that were let in for the key, so the total is a plain sum.
    """
    fields = [c for c in existing.columns if c not in (*keys, "batch", order)]
    row = F.struct(*fields)
    fresh = incoming.groupBy(*keys).agg(
        F.max_by(row, F.col(order)).alias("_new"),
        F.min(order).alias("_new_ord"),
        F.count("*").alias("_arrivals"),
    )
    stored = existing.select(*keys, F.col("batch"), F.col(order), row.alias("_old"))
    kept = F.col(f"_old.{status}") == final
    merged = stored.join(fresh, list(keys), "full_outer")
    blocked = F.coalesce(kept, F.lit(False))
    return merged.select(
        *keys,
        F.col("batch"),
        F.coalesce(F.col(order), F.col("_new_ord")).alias(order),
        F.when(blocked, F.col("_old")).otherwise(F.coalesce("_new", "_old")).alias("_row"),
        F.when(blocked, F.lit(0)).otherwise(F.coalesce("_arrivals", F.lit(0))).cast("bigint").alias("accepted"),
    ).select(*keys, "batch", order, "_row.*", "accepted")


def first_n_cutoff(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Per key the order value of its n-th row: rows at or below it are the first n.

    Ranked twice: inside salted slices of a key, then over the at most n rows left per slice. Each
    ranking is trimmed per task before its shuffle (for n up to 1000), and no task ranks a whole hot
    key, however many tasks send it candidates.
    """
    salted = df.select(*keys, order, F.pmod(F.xxhash64(order), F.lit(_SALTS)).alias("_salt"))

    def first_n(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")

    candidates = first_n(salted, *keys, "_salt").drop("_salt")
    return first_n(candidates, *keys).groupBy(*keys).agg(F.max(order).alias("cutoff"))
