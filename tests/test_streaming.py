import datetime
import json

import pytest
from pyspark.sql import functions as F

from pathloom.model import WindowSettings
from pathloom.operators import metrics as M
from pathloom.operators import sessions as S
from pathloom.sources import readers, sinks
from pathloom.streaming import pipeline as P

T0 = datetime.datetime(2024, 1, 1, 12)
MESSAGE = "value string, timestamp timestamp"


def message(k, seconds, kind="view", user=1, session="s1"):
    t = (T0 + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S UTC")
    return json.dumps({"event_time": t, "event_type": kind, "product_id": k, "price": 10.0, "user_id": user, "user_session": session})


def drop(spark, path, values):
    spark.createDataFrame([(v, T0) for v in values], MESSAGE).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return readers.file_stream(spark, path, spark.createDataFrame([], MESSAGE).schema, files_per_trigger=1)


def settings(tmp_path, **more):
    return P.StreamSettings(str(tmp_path / "ck"), str(tmp_path / "out"), available_now=True, **more)


def finish(queries):
    for q in queries if isinstance(queries, list) else [queries]:
        q.awaitTermination(120)
        assert q.exception() is None


def test_the_whole_pipeline(spark, tmp_path):
    src = str(tmp_path / "in")
    drop(spark, src, [message(k, 60 * k) for k in range(5)] + ["{bad"])
    drop(spark, src, [message(9, 40_000, "purchase", 2, "s2")])
    drop(spark, src, [message(9, 90_000, "view", 3, "s3")])
    s = settings(tmp_path)
    products = spark.createDataFrame([(1, "Phones")], "product_id long, category_name string")
    finish(P.run(spark, stream(spark, src), s, products))
    read = lambda n: spark.read.parquet(f"{s.tables}/{n}")
    assert read("enriched_events").count() == 7 and read("enriched_events").filter("category_name = 'Phones'").count() == 1
    assert [r.value for r in read("dead_letters").collect()] == ["{bad"]
    parts = {r.user_session: r for r in read("user_behaviors").collect()}
    assert parts["s1"].total_events == 5 and parts["s1"].session_duration_minutes == 4.0 and parts["s2"].total_amount == 10.0
    assert read("windowed_metrics").agg(F.sum("event_count")).first()[0] == 6
    metrics = {r.user_session: r for r in read("session_metrics").collect()}
    assert metrics["s1"].view_count == 5 and metrics["s1"].gross_price_sum == 50.0 and metrics["s1"].unique_categories == 1 and metrics["s2"].converted_to_purchase
    assert {"unique_categories", "avg_purchase_price", "avg_product_price_viewed", "remove_cart_count"} <= set(read("user_behaviors").columns)
    want = S.segment_distribution(read("user_behaviors"))
    cells = lambda df: sorted((r.window_start, r.behavior_segment, r.session_count, r.total_revenue or 0) for r in df.collect())
    assert cells(read("segment_distribution")) == cells(want) and want.count() == 2


def test_the_distribution_follows_later_sessions_of_a_window(spark, tmp_path):
    s = settings(tmp_path)
    each = P.sessions_each(s)
    good, _ = P.parsed(spark.createDataFrame([(message(k, 10 * k, user=k, session=f"s{k}"), T0) for k in range(6)] + [(message(9, 3600, user=9, session="s9"), T0)], MESSAGE))
    parts = P.keyed_sessions(good.withColumn("category_code", F.lit("c")), s)
    each(parts.filter("user_id < 3"), 0)
    each(parts.filter("user_id >= 3"), 1)
    each(parts.filter("user_id >= 3"), 1)  # the same batch again
    got = {r.window_start: r.session_count for r in spark.read.parquet(f"{s.tables}/segment_distribution").collect()}
    assert got == {T0: 6, T0 + datetime.timedelta(hours=1): 1}


def test_each_message_is_parsed_for_events_once(spark, tmp_path):
    src = str(tmp_path / "in")
    drop(spark, src, [message(k, 60 * k) for k in range(5)])
    queries = P.run(spark, stream(spark, src), settings(tmp_path))
    finish(queries)
    reading = [q.name for q in queries if "from_json" in q._jsq.explainInternal(False)]
    assert reading == ["enriched_events", "dead_letters"]


def test_a_stream_gives_the_windows_that_a_batch_gives_once_they_close(spark, tmp_path):
    src = str(tmp_path / "in")
    values = [message(k % 7, 37 * k, ("view", "cart")[k % 2], k % 3) for k in range(200)]
    for part in range(4):
        drop(spark, src, values[50 * part : 50 * part + 50])
    s = settings(tmp_path)
    good, _ = P.parsed(stream(spark, src))
    finish(P.start(P.windowed(good, s), "w", s))
    batch, _ = P.parsed(spark.read.parquet(src))
    want = M.flat_window(M.windowed_metrics(batch, exact=False))
    end = T0 + datetime.timedelta(seconds=37 * 199) - datetime.timedelta(minutes=10)
    key = lambda df: sorted((r.window_start, r.event_type, r.event_count, r.gross_price_sum, r.unique_users) for r in df.collect())
    assert key(spark.read.parquet(f"{s.tables}/w")) == key(want.filter(F.col("window_end") <= F.lit(end)))


def test_late_rows_are_dropped_and_counted_and_a_restart_goes_on(spark, tmp_path):
    src = str(tmp_path / "in")
    progress = P.Progress()
    spark.streams.addListener(progress)
    try:
        s = settings(tmp_path, window=WindowSettings("5 minutes", None, "1 minute"))
        drop(spark, src, [message(1, 0), message(2, 30)])
        drop(spark, src, [message(3, 3600)])
        good = lambda: P.windowed(P.parsed(stream(spark, src))[0], s)
        finish(P.start(good(), "late", s))
        drop(spark, src, [message(4, 10), message(5, 7200)])
        drop(spark, src, [message(6, 9000)])
        finish(P.start(good(), "late", s))
        rows = {r.window_start: r.event_count for r in spark.read.parquet(f"{s.tables}/late").collect()}
        assert rows[T0] == 2 and rows[T0 + datetime.timedelta(hours=1)] == 1
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert progress.latest["late"]["late"] == 1
    finally:
        spark.streams.removeListener(progress)


def test_upserts_are_idempotent_and_batches_are_shared(spark, tmp_path):
    src = str(tmp_path / "in")
    drop(spark, src, [message(1, 0), message(2, 5, user=2)])
    s = settings(tmp_path)
    store = P.upsert_to(f"{s.tables}/users", ["user_id"])
    seen = []

    def latest(batch, n):
        store(batch.select("user_id", "product_id"), n)
        store(batch.select("user_id", "product_id"), n)

    good, _ = P.parsed(stream(spark, src))
    finish(P.shared_batches(good, "shared", s, {"users": latest, "count": lambda b, n: seen.append(b.count())}))
    assert seen == [2] and spark.read.parquet(f"{s.tables}/users").count() == 2


def test_complete_output_of_live_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    drop(spark, src, [message(1, 0), message(2, 5, "purchase")])
    good, _ = P.parsed(stream(spark, src))
    q = P.live_behaviours(good.withColumn("category_code", F.lit("c"))).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    finish(q)
    r = spark.table("live").first()
    assert r.total_events == 2 and r.total_amount == 10.0 and r.behavior_segment == "unclassified"


def test_a_second_watermark_is_not_set_by_enriching(spark, tmp_path):
    from pathloom.operators import events as E

    src = str(tmp_path / "in")
    drop(spark, src, [message(1, 0)])
    good, _ = P.parsed(stream(spark, src))
    text = M.windowed_metrics(E.enrich(good, None, None))._jdf.queryExecution().analyzed().toString()
    assert text.count("EventTimeWatermark") == 1
    assert E.enrich(good, None, None, "5 minutes")._jdf.queryExecution().analyzed().toString().count("EventTimeWatermark") == 1


def test_monitor_stops_all_when_one_ends(spark, tmp_path):
    src = str(tmp_path / "in")
    drop(spark, src, [message(1, 0)])
    s = settings(tmp_path)
    good, _ = P.parsed(stream(spark, src))
    q = P.start(good, "m", s)
    finish(q)
    told = []
    P.monitor([q], 0.1, told.append)
    assert not q.isActive


def test_complete_output_never_passes_through_the_driver(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(T0 + datetime.timedelta(hours=3 * k), k % 7) for k in range(700)]
    spark.createDataFrame(rows, "t timestamp, u int").repartition(3).write.parquet(src)
    provider = spark.conf.get(P.PROVIDER)
    out = P.complete(spark.readStream.schema("t timestamp, u int").option("maxFilesPerTrigger", 1).parquet(src).groupBy("u").agg(F.count(F.lit(1)).alias("n")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "MemoryPlan" not in plan and "LocalRelation" not in plan
    assert sorted((r.u, r.n) for r in out.collect()) == [(u, 100) for u in range(7)] and spark.conf.get(P.PROVIDER) == provider
    nothing = str(tmp_path / "nothing")
    spark.createDataFrame([], "t timestamp, u int").write.parquet(nothing)
    assert P.complete(spark.readStream.schema("t timestamp, u int").parquet(nothing).groupBy("u").count()).count() == 0
    from pathloom.plans import streaming

    for query in (streaming.streamed_sessions, streaming.streamed_windows):
        assert "MemoryPlan" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
