"""Batch sinks and layouts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import expressions as X
from pathloom.operators.recommend import top_per_group


def partitioned(df: DataFrame, path: str, by=("event_date", "event_type"), mode="append") -> None:
    """Folders by value; rows of one folder are gathered first, so that a task doesn't open a file in each."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def bucketed(df: DataFrame, table: str, by: str = "user_id", buckets: int = 20, sort: str = "event_timestamp") -> None:
    """A managed table on which joins and aggregates by the same key need no shuffle."""
    df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(sort).saveAsTable(table)


def parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old whose key isn't in new, and all of new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


PART = "key_part"


def last_of(rows: DataFrame, key: list[str], last: str | None = None) -> DataFrame:
    """One row a key: the one with the largest `last`; among equals, and without it, one that a hash of the row picks."""
    order = [F.desc_nulls_last(last)] if last else []
    return top_per_group(rows, key, [*order, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])], 1)


def rename(files, old, new) -> None:
    """Hadoop tells a failure by its result."""
    if not files.rename(old, new):
        raise OSError(f"{old} can't be renamed to {new}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, of spark.checkpoint.dir; a local session without one gets one of its machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if given is None:
        given = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext.setCheckpointDir(given)
    return given


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def upsert(new: DataFrame, path: str, key: list[str], stamp: str | None = "updated_at", last: str | None = None, parts: int = 16) -> None:
    """Replaces rows of a Parquet folder by key; of rows with one key in `new`, the last one counts.

    The table lies in folders by hash of the key (column key_part). Only folders that `new` touches are read and written:
    first beside the old ones, then each takes its place. If that fails, the old folder is put back and the error raised;
    every folder is old or new as a whole, and the same call again completes the rest."""
    spark = new.sparkSession
    if stamp and stamp not in new.columns:
        new = new.withColumn(stamp, F.date_format(F.current_timestamp(), X.WRITTEN))
    new = last_of(new, key, last).withColumn(PART, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    place = spark._jvm.org.apache.hadoop.fs.Path
    root = path.rstrip("/")
    files = place(root).getFileSystem(spark._jsc.hadoopConfiguration())
    beside, aside = f"{root}/_new-{uuid.uuid4().hex}", f"{root}/_old-{uuid.uuid4().hex}"
    try:
        rows = new
        if files.exists(place(root)) and any(f.getPath().getName().startswith(f"{PART}=") for f in files.listStatus(place(root))):
            touched = [r[0] for r in new.select(PART).distinct().collect()]  # at most `parts`
            rows = merged(spark.read.parquet(root).filter(F.col(PART).isin(touched)), new, key)
        rows.repartition(PART).write.partitionBy(PART).parquet(beside)
        files.mkdirs(place(aside))
        for made in [f.getPath() for f in files.listStatus(place(beside)) if f.getPath().getName().startswith(f"{PART}=")]:
            here, old = place(root, made.getName()), place(aside, made.getName())
            had = files.exists(here)
            if had:
                rename(files, here, old)
            try:
                rename(files, made, here)
            except BaseException:
                if had:
                    files.rename(old, here)
                raise
        files.delete(place(aside), True)
    finally:
        files.delete(place(beside), True)


def show(df: DataFrame, n: int = 10) -> str:
    """The first rows as text."""
    return df._show_string(n, False)


def plan(df: DataFrame) -> str:
    """The formatted physical plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
