"""Queries that run a stream over the events to its end. Complete output is for such checks; the pipeline writes tables by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import metrics as M
from pathloom.plans.events import RAW
from pathloom.plans.registry import query, rounded
from pathloom.sources import testdata as D
from pathloom.streaming import pipeline as P


def streamed(spark, d):
    """The events as a stream of files, seen as this engine's events."""
    schema = D.table(spark, d, "events").schema
    return D.as_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)).withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))


def finished(df):
    """What the stream has at its end, which the executors write: neither rows nor state pass through the driver."""
    return P.complete(df)


@query(
    "st2_streamed_windows",
    f"""WITH {RAW} SELECT time_bucket(INTERVAL 5 MINUTE, event_timestamp) AS window_start, event_type, count(*) AS event_count, round(sum(price) + 1e-9, 6) AS gross_price_sum, round(avg(price) + 1e-9, 6) AS avg_price
    FROM e GROUP BY ALL""",
)
def streamed_windows(spark, d):
    out = M.flat_window(M.windowed_metrics(streamed(spark, d)))
    return finished(rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "event_count", "gross_price_sum", "avg_price")))


@query(
    "st4_streamed_sessions",
    f"""WITH {RAW}, g AS (SELECT *, CASE WHEN event_timestamp - lag(event_timestamp) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id, user_session ORDER BY event_timestamp, event_id)),
    p AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, user_session ORDER BY event_timestamp, event_id) AS part FROM g)
    SELECT min(event_timestamp) AS part_start, user_id, user_session, max(event_timestamp) AS session_end, count(*) AS total_events, count(*) FILTER (WHERE event_type = 'view') AS view_count,
      count(*) FILTER (WHERE event_type = 'cart') AS cart_count, count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count, round(sum(price) + 1e-9, 6) AS gross_price_sum,
      round(sum(price) FILTER (WHERE event_type = 'purchase') + 1e-9, 6) AS total_amount FROM p GROUP BY user_id, user_session, part""",
)
def streamed_sessions(spark, d):
    events = streamed(spark, d).withColumn("category_code", F.lit(None).cast("string"))
    out = P.keyed_sessions(events, P.StreamSettings("", ""))
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("part_start", "session_end")]
    # chosen before the stream runs: what isn't asked for takes no state
    return finished(rounded(out.select(*times, "user_id", "user_session", "total_events", "view_count", "cart_count", "purchase_count", "gross_price_sum", "total_amount")))
