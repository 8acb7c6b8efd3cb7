"""Named queries over a table folder, each with the SQL that must give the same rows."""
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def keep(run: Query) -> Query:
        CATALOG[run.__name__] = Entry(run, sql)
        return run

    return keep
