"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, as sums of doubles depend on their order beyond that, and dates as text. The SQL adds the same billionth, which takes exact halves off the edge."""

    def plain(f):
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        return F.round(c + 1e-9, digits).alias(f.name) if kind == "double" else c.cast("string").alias(f.name) if kind == "date" else c

    return df.select(*[plain(f) for f in df.schema])


def queries() -> dict[str, Callable]:
    from pathloom.plans import events, learning, recommend, serving, streaming  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
