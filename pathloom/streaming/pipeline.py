"""The streaming pipeline: parse, set aside, enrich, and six outputs, with keyed upserts for what changes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pathloom.model import WindowSettings
from pathloom.operators import events as E
from pathloom.operators import metrics, sessions
from pathloom.sources import sinks


@dataclass(frozen=True)
class StreamSettings:
    checkpoints: str
    tables: str
    #: None takes the session's setting.
    trigger: str | None = None
    available_now: bool = False
    #: A session still open after so long without events is closed and leaves the state.
    session_idle: str = "2 hours"
    window: WindowSettings = field(default_factory=WindowSettings)


def start(df: DataFrame, name: str, s: StreamSettings, mode: str = "append", each=None) -> StreamingQuery:
    """df to the table `name`, with its own checkpoint; each(batch, id) instead of plain files where given."""
    writer = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{s.checkpoints}/{name}")
    writer = writer.trigger(availableNow=True) if s.available_now else writer.trigger(processingTime=s.trigger or df.sparkSession.conf.get("spark.pathloom.trigger", "10 seconds"))
    return (writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{s.tables}/{name}")).start()


def upsert_to(path: str, key: list[str], last: str | None = None):
    """For foreachBatch: the same batch again leaves the same table."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sinks.upsert(batch, path, key, stamp=None, last=last)

    return each


def parsed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good events, dead letters) of raw messages with value and timestamp."""
    keep = ("timestamp",) if "timestamp" in raw.columns else ()
    good, bad = E.split_valid(raw, keep=keep)
    return (good.withColumnRenamed("timestamp", "kafka_timestamp") if keep else good), bad


def windowed(events: DataFrame, s: StreamSettings) -> DataFrame:
    return metrics.flat_window(metrics.windowed_metrics(events, s.window, exact=False))


def keyed_sessions(events: DataFrame, s: StreamSettings) -> DataFrame:
    """Session metrics whose state ends: a session's key is kept within windows of inactivity, so late returns begin a new part."""
    watched = events.withWatermark("event_timestamp", s.window.watermark)
    gap = F.session_window("event_timestamp", s.session_idle)
    named = F.col("category_name") if "category_name" in events.columns else F.lit(None)
    out = watched.groupBy(gap.alias("w"), *sessions.KEY).agg(*sessions.behaviour_columns(exact=False), F.sum("price").alias("gross_price_sum"), F.approx_count_distinct(named).alias("named_categories"))
    length = (F.unix_timestamp("session_end") - F.unix_timestamp("session_start")) / 60.0
    return out.select(F.col("w.start").alias("part_start"), *out.columns[1:], F.when(length == 0, 0.1).otherwise(length).alias("session_duration_minutes"))


def closed_sessions(parts: DataFrame) -> DataFrame:
    """The columns of session_metrics from closed parts; a part of no length has 0 minutes here."""
    minutes = (F.unix_timestamp("session_end") - F.unix_timestamp("session_start")) / 60.0
    counts = [f"{t}_count" for t in ("view", "cart", "purchase")]
    return parts.select(
        "part_start", *sessions.KEY, "session_start", "session_end", "total_events", *counts, "gross_price_sum", "unique_products", F.col("named_categories").alias("unique_categories"),
        minutes.alias("session_duration_minutes"), (F.col("cart_count") > 0).alias("converted_to_cart"), (F.col("purchase_count") > 0).alias("converted_to_purchase"),
    )


def live_sessions(events: DataFrame, exact: bool = False) -> DataFrame:
    """Session metrics over unbounded state, for complete or update output, as long as the sessions fit."""
    return sessions.session_metrics(events, exact)


def live_behaviours(events: DataFrame, exact: bool = False) -> DataFrame:
    return sessions.classify(sessions.behaviour_metrics(events, exact))


def sessions_each(s: StreamSettings):
    """For foreachBatch over keyed_sessions: session metrics, classified parts, and the segment distribution of the windows
    in which these begin, made again from the table, as a stream can't chain a second aggregate."""
    key = ["part_start", *sessions.KEY]
    metrics_to = upsert_to(f"{s.tables}/session_metrics", key, "session_end")
    behaviours_to = upsert_to(f"{s.tables}/user_behaviors", key, "session_end")
    distribution_to = upsert_to(f"{s.tables}/segment_distribution", ["window_start", "behavior_segment"])

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            metrics_to(closed_sessions(batch), n)
            behaviours_to(sessions.classify(batch.drop("gross_price_sum", "named_categories")), n)
            start = F.window("session_start", s.window.duration)["start"]
            touched = batch.select(start.alias("t")).distinct()
            ends = touched.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
            # the bounds reach the scan; the exact windows are joined
            table = batch.sparkSession.read.parquet(f"{s.tables}/user_behaviors").filter(F.col("session_start") >= ends.a)
            table = table.filter(F.col("session_start") < F.lit(ends.b) + F.expr(f"interval {s.window.duration}"))
            rows = table.withColumn("t", start).join(touched, "t", "left_semi").drop("t")
            distribution_to(sessions.segment_distribution(rows, s.window.duration), n)
        finally:
            batch.unpersist()

    return each


def enriched_stream(spark: SparkSession, like: DataFrame, s: StreamSettings) -> DataFrame:
    """What the enriched output has written, as a stream: each message is parsed for it once, and no row is read twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{s.tables}/enriched_events")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.readStream.schema(like.schema).parquet(f"{s.tables}/enriched_events")


def run(spark: SparkSession, raw: DataFrame, s: StreamSettings, products: DataFrame | None = None, users: DataFrame | None = None) -> list[StreamingQuery]:
    """Starts enriched events and dead letters on the source, and windows and sessions on the enriched events."""
    good, bad = parsed(raw)
    enriched = E.stamp_processing(E.enrich(good, products, users))
    first = [start(enriched, "enriched_events", s), start(bad, "dead_letters", s)]
    if s.available_now:
        first[0].awaitTermination()
    written = enriched_stream(spark, enriched, s)
    return [
        *first,
        start(windowed(written, s), "windowed_metrics", s),
        start(keyed_sessions(written, s), "user_behaviors", s, "append", sessions_each(s)),
    ]


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def complete(df: DataFrame) -> DataFrame:
    """The complete output of a stream over all that is there now, from a table that each batch writes anew. State is in RocksDB,
    off the heap; the query takes the setting when it starts."""
    spark = df.sparkSession
    home = f"{sinks.shared_folder(spark)}/pathloom-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{home}/rows")  # also where no batch comes
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = df.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{home}/state")
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{home}/rows")).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    sinks.delete(spark, f"{home}/state")
    return spark.read.schema(df.schema).parquet(f"{home}/rows")


def shared_batches(events: DataFrame, name: str, s: StreamSettings, outputs: dict) -> StreamingQuery:
    """One query that reads and parses each batch once and hands it to every output(batch, id)."""

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for output in outputs.values():
                output(batch, n)
        finally:
            batch.unpersist()

    return start(events, name, s, each=each)


class Progress(StreamingQueryListener):
    """The last figures of each query: rows, rows a second, and rows that came behind the watermark."""

    def __init__(self):
        self.latest: dict[str, dict] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.latest.setdefault(event.name or str(event.id), {})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        now = self.latest.setdefault(p.name or str(p.id), {})
        now |= {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "late": now.get("late", 0) + late}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def monitor(queries: list[StreamingQuery], every: float = 10.0, tell=print) -> None:
    """Tells progress while all are active; when one ends or the user interrupts, all are stopped."""
    try:
        while queries and all(q.isActive for q in queries):
            for q in queries:
                last = q.lastProgress
                if last:
                    tell(f"{q.name}: {last['numInputRows']} rows, {last['processedRowsPerSecond']} a second")
            queries[0].awaitTermination(every)
    except KeyboardInterrupt:
        tell("stopping")
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
