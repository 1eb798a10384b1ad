"""Batch and streaming sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.model import PRODUCT, USER, schema

#: What a topic's messages are read as.
MESSAGE = schema("value string, timestamp timestamp")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, limit: int | None = None) -> DataFrame:
    """With a header; every column a string where no schema is given, never inferred."""
    out = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=False)
    return out.limit(limit) if limit else out


def json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def product_dimension(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, PRODUCT)


def user_dimension(spark: SparkSession, path: str) -> DataFrame | None:
    """None where there is no such file."""
    return csv(spark, path, USER) if exists(spark, path) else None


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def events_and_sessions(spark: SparkSession, events: str, sessions: str) -> tuple[DataFrame, DataFrame | None]:
    """Events with a time and a user, and the sessions table if there is one."""
    rows = spark.table(events).filter(F.col("event_timestamp").isNotNull() & F.col("user_id").isNotNull())
    return rows, table_or_none(spark, sessions)


@dataclass(frozen=True)
class Kafka:
    """A topic. The connector is a separate jar; without it Spark says so on load."""

    servers: str
    topic: str
    options: dict = field(default_factory=lambda: {"startingOffsets": "latest", "failOnDataLoss": "false", "kafka.session.timeout.ms": "30000", "kafka.request.timeout.ms": "40000"})

    def settings(self) -> dict:
        return {"kafka.bootstrap.servers": self.servers, "subscribe": self.topic} | self.options

    def read_stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.format("kafka").options(**self.settings()).load()

    @staticmethod
    def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
        value = F.to_json(F.struct("*")).alias("value")
        return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)

    def write_stream(self, df: DataFrame, checkpoint: str):
        sink = self.as_messages(df).writeStream.format("kafka").option("kafka.bootstrap.servers", self.servers)
        return sink.option("topic", self.topic).option("checkpointLocation", checkpoint).start()

    def write_batch(self, df: DataFrame, key: str | None = None) -> None:
        """Acknowledged by all replicas, with three retries."""
        out = self.as_messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("topic", self.topic)
        out.option("kafka.acks", "all").option("kafka.retries", "3").save()


@dataclass(frozen=True)
class Collections:
    """Named result tables behind one interface: Parquet folders here, or any format with its options (a document store's, say)."""

    root: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)

    @classmethod
    def of_session(cls, spark: SparkSession, root: str | None = None, format: str = "parquet", options: dict | None = None) -> Collections:
        """The tables of a session: in `root`, or else where its setting spark.pathloom.tables says."""
        where = root or spark.conf.get("spark.pathloom.tables", None)
        if not where:
            raise ValueError("name a folder or database of tables, or set spark.pathloom.tables")
        return cls(where, format, options or {})

    def _place(self, name: str) -> dict:
        return self.options | ({"path": f"{self.root}/{name}"} if self.format in ("parquet", "json", "orc") else {"database": self.root, "collection": name})

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.format(self.format).options(**self._place(name)).load()

    def write(self, df: DataFrame, name: str, mode: str = "append") -> None:
        df.write.format(self.format).options(**self._place(name)).mode(mode).save()

    def count(self, spark: SparkSession, name: str) -> int:
        return self.read(spark, name).count()

    def write_all(self, tables: dict[str, DataFrame | None]) -> dict[str, Exception]:
        """Each table overwritten; one that fails doesn't stop the others. Returns what failed."""
        failed = {}
        for name, df in tables.items():
            if df is not None:
                try:
                    self.write(df, name, "overwrite")
                except Exception as error:  # noqa: BLE001
                    failed[name] = error
        return failed


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream; the replay of recorded events at files_per_trigger a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)
