"""Helpers that the operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, of spark.checkpoint.dir. Where that is unset, a local session gets one of its
    machine; a cluster, whose executors couldn't read each other's parts there, an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if given is None and sc.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="pathloom-"))
    return given or sc.getCheckpointDir()


_STORED: dict[str, tuple] = {}


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and losing an executor loses nothing.

    The table stays until discard(), release() or the end of the driver, as results may still be read from it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathloom-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(release)
    _STORED[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pathloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a result of stored() that nothing reads any more."""
    remove(df._pathloom_path)


def remove(path: str) -> None:
    if path in _STORED:
        jvm, conf = _STORED.pop(path)
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def release() -> None:
    """Deletes the tables that stored() has written."""
    for path in list(_STORED):
        try:
            remove(path)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            return


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most BATCH_BYTES: a task holds a few at once, on the JVM's side and on Python's."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def mapped(df: DataFrame, added: str, make, drop: tuple[str, ...] = ()) -> DataFrame:
    """df and the added columns (DDL), which make() computes from each Arrow batch as {name: array}; `drop` leaves after that.

    make() is called once a task and returns the function for the batches.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df, added)
    names = [f.name.lower() for f in T.StructType.fromDDL(added)]
    schema = T.StructType([f for f in schema if f.name.lower() in names or f.name.lower() not in drop])
    kept = [f.name for f in schema if f.name.lower() not in names]

    def run(batches):
        compute = make()
        for batch in batches:
            new = compute(batch)
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in kept} | new
            yield pa.RecordBatch.from_arrays([columns[f] for f in (*kept, *new)], names=[*kept, *new])

    return df.mapInArrow(run, schema)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose names, in any case, an operator is about to add."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def extended(df: DataFrame, added: str) -> T.StructType:
    """df's schema and the added columns, given as DDL; an added one replaces one of the same name."""
    more = T.StructType.fromDDL(added)
    names = {f.name.lower() for f in more}
    return T.StructType([f for f in df.schema if f.name.lower() not in names] + list(more))


def holds_any(text: str, exact: list[str], lowered: list[str]):
    """Whether a text holds any of the words of `exact` as they are, or of `lowered` in any case: plain searches, many times as
    fast as a pattern. The array of one binds the lower case, which is made once."""
    holds = lambda t, words: reduce(or_, [F.contains(t, F.lit(w)) for w in words], F.lit(False))
    return holds(F.col(text), exact) | F.exists(F.array(F.lower(text)), lambda low: holds(low, lowered))


def row_key(text: str = "text"):
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
