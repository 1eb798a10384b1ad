"""Column expressions that several operators share; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.model import FeatureSettings


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(text: Column | str) -> Column:
    """Zoned clock times such as 2019-10-01 00:00:00 UTC, or ISO 8601; null for anything else."""
    return F.coalesce(F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd HH:mm:ss z")), F.try_to_timestamp(col(text)))


def text(name: str, out: str | None = None) -> Column:
    return F.col(name).cast("string").alias(out or name)


def in_text_order(name: str) -> Column:
    """Ascending as ids are compared: as text, whatever type they are moved as."""
    return F.asc(F.col(name).cast("string"))


def with_text(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns as text, in place."""
    return df.withColumns({c: F.col(c).cast("string") for c in names})


#: What a product must have to be scored, and how times are written in result tables.
TRAITS = ["brand", "category_code", "price"]
WRITTEN = "yyyy-MM-dd'T'HH:mm:ss"


def is_type(name: str) -> Column:
    return F.col("event_type") == name


def count_type(name: str) -> Column:
    return F.count_if(is_type(name))


def share(part: Column | str, whole: Column | str, scale: float = 1.0) -> Column:
    """part / whole * scale, 0.0 where whole isn't positive."""
    return F.when(col(whole) > 0, col(part) / col(whole) * scale).otherwise(0.0)


def minutes_between(start: str, end: str) -> Column:
    """Whole seconds between two times, as minutes."""
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return (seconds(end) - seconds(start)) / 60.0


def price_category(price: Column | str, s: FeatureSettings = FeatureSettings()) -> Column:
    a, b, c = s.price_bands
    p = col(price)
    return F.when(p.isNull(), None).when(p < a, "Budget").when(p < b, "Mid-Range").when(p < c, "Premium").otherwise("Luxury")


def is_weekend(time: Column | str) -> Column:
    return F.dayofweek(col(time)).isin(1, 7)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate, which never runs anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of input files for each task of a step that moves or widens all rows of its input.
TASK_BYTES = 4 << 20


def parts_for(df: DataFrame) -> int:
    """Tasks for a shuffle of df by the size of the files that it is made from, so that a task's share stays the same as the
    input grows, and as many as the session has at once; 0 where all is one task's share. More shuffle partitions of the session are no
    reason for 0: adaptive execution joins those up to its advisory size. Rows that don't come from files have no known size and count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    total = sum(x for x in sizes if x < 1 << 60)
    parts = -(-total // int(df.sparkSession.conf.get("spark.pathloom.taskBytes", str(TASK_BYTES))))
    at_once = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return max(parts, at_once) if parts > 1 else 0


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """df moved by keys to parts_for(df) tasks, or as it is. A window or aggregate by these keys needs no shuffle of its own then."""
    parts = parts_for(df) if parts is None else parts
    return df.repartition(parts, *keys) if parts else df


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df marked for broadcast while its estimated size is within limit; larger ones are joined by a shuffle.

    Without a limit, that of the session's settings counts."""
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    limit = int(df.sparkSession.conf.get("spark.pathloom.broadcastBytes", str(64 << 20))) if limit is None else limit
    return estimated_bytes(df) <= limit
