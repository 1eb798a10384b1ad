import os

import pytest
from pyspark.sql import functions as F

from pathloom import session
from pathloom.model import CATEGORY, PRODUCT, SessionSettings
from pathloom.operators import sessions as S
from pathloom.operators import events as E
from pathloom.sources import generators as G
from pathloom.settings import Deployment
from pathloom.sources import readers, replay, sinks


def test_csv_with_a_schema_and_all_strings(spark, tmp_path):
    made = G.minimal_catalog(spark, 20)
    sinks.csv(made, str(tmp_path / "c"))
    text = readers.csv(spark, str(tmp_path / "c"))
    assert {t for _, t in text.dtypes} == {"string"} and readers.csv(spark, str(tmp_path / "c"), limit=3).count() == 3
    assert readers.user_dimension(spark, str(tmp_path / "nothing")) is None
    full = G.product_catalog(spark.createDataFrame([(1, "a.b", 3.0, 1), (1, "c.d", 4.0, 2), (2, None, 5.0, 3)], "product_id long, category_code string, price double, k long"), ["k"])
    sinks.csv(full, str(tmp_path / "p"))
    back = readers.product_dimension(spark, str(tmp_path / "p"))
    assert back.schema == PRODUCT
    got = {r.product_id: (r.category_name, r.subcategory, r.brand, r.original_price) for r in back.collect()}
    assert got[1] == ("A", "b", "Generic", 3.0) and got[2][0] == "Uncategorized"


def test_collections(spark, tmp_path):
    c = readers.Collections(str(tmp_path))
    c.write(spark.range(3), "a")
    c.write(spark.range(2), "a")
    assert c.count(spark, "a") == 5
    failed = c.write_all({"a": spark.range(4), "b": spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), "c": None})
    assert c.count(spark, "a") == 4 and set(failed) == {"b"}


def test_upsert_replaces_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), path, ["id"])
    sinks.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), path, ["id"])
    rows = spark.read.parquet(path).collect()
    assert {(r.id, r.v) for r in rows} == {(1, "a"), (2, "c"), (3, "d")} and all(r.updated_at for r in rows)
    assert os.listdir(tmp_path) == ["t"]


def folders(path):
    return {f: sorted(os.listdir(f"{path}/{f}")) for f in os.listdir(path) if f.startswith("key_part=")}


def test_upsert_writes_only_the_folders_it_touches_and_the_last_row_of_a_key_counts(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v string, n int"
    sinks.upsert(spark.createDataFrame([(k, "a", 0) for k in range(100)], schema), path, ["id"], last="n")
    before = folders(path)
    sinks.upsert(spark.createDataFrame([(7, "b", 1), (7, "d", 3), (7, "c", 2), (None, "x", 1)], schema), path, ["id"], last="n")
    after = folders(path)
    assert len(before) == 16 and sum(before[f] != after[f] for f in before) <= 2
    assert {(r.id, r.v) for r in spark.read.parquet(path).filter("v <> 'a'").collect()} == {(7, "d"), (None, "x")} and spark.read.parquet(path).count() == 101


def test_a_rename_that_fails_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(k, "a") for k in range(50)], "id long, v string")
    sinks.upsert(rows, path, ["id"])
    before, real, calls = sorted(map(tuple, spark.read.parquet(path).collect())), sinks.rename, []

    def failing(files, old, new):
        calls.append(old)
        if len(calls) == 2:  # the old folder is aside, the new one isn't there yet
            raise OSError("no")
        real(files, old, new)

    monkeypatch.setattr(sinks, "rename", failing)
    with pytest.raises(OSError):
        sinks.upsert(rows.withColumn("v", F.lit("b")), path, ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == before
    monkeypatch.setattr(sinks, "rename", real)
    sinks.upsert(rows.withColumn("v", F.lit("b")), path, ["id"])
    assert {r.v for r in spark.read.parquet(path).collect()} == {"b"} and spark.read.parquet(path).count() == 50


def test_replay_paces_and_tries_again(spark):
    sent, waits, failures = [], [], [1, 1]

    def send(df):
        if failures:
            failures.pop()
            raise OSError("away")
        sent.append([r.id for r in df.collect()])

    assert replay.replay(spark.range(7), send, ["id"], 3, 0.25, 3, waits.append) == 7
    assert sent == [[0, 1, 2], [3, 4, 5], [6]] and waits == [0.5, 1.0, 0.25, 0.25, 0.25]
    with pytest.raises(OSError):
        replay.attempt(lambda: (_ for _ in ()).throw(OSError("no")), 2, waits.append)


def test_collections_and_deployment_come_from_settings(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        readers.Collections.of_session(spark)
    spark.conf.set("spark.pathloom.tables", str(tmp_path))
    try:
        readers.Collections.of_session(spark).write(spark.range(2), "a")
        assert readers.Collections(str(tmp_path)).count(spark, "a") == 2
    finally:
        spark.conf.unset("spark.pathloom.tables")
    made = Deployment.from_environment({"PATHLOOM_TOPIC": "t", "PATHLOOM_CHUNK_ROWS": "5", "PATHLOOM_PAUSE_SECONDS": "0.5", "OTHER": "x"})
    assert (made.topic, made.chunk_rows, made.pause_seconds, made.retries) == ("t", 5, 0.5, 3)
    with pytest.raises(ValueError, match="CHUNK_ROWS"):
        Deployment.from_environment({"PATHLOOM_CHUNK_ROWS": "many"})


def test_the_session_s_limit_decides_on_broadcasts(spark):
    from pathloom.functions import expressions as X

    hinted = lambda df: "ResolvedHint" in X.small_side(df)._jdf.queryExecution().analyzed().toString()
    assert hinted(spark.range(10))
    spark.conf.set("spark.pathloom.broadcastBytes", "10")
    try:
        assert not hinted(spark.range(10))
    finally:
        spark.conf.unset("spark.pathloom.broadcastBytes")


def test_partitions_are_pruned_and_buckets_spare_the_shuffle(spark, tmp_path):
    e = spark.range(200).select((F.col("id") % 20).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("event_timestamp"), F.when(F.col("id") % 2 == 0, "view").otherwise("cart").alias("event_type"))
    path = str(tmp_path / "p")
    sinks.partitioned(E.with_date(e), path)
    sinks.partitioned(E.with_date(e), path)
    assert spark.read.parquet(path).count() == 400
    assert "PartitionFilters: [isnotnull(event_type" in sinks.plan(spark.read.parquet(path).filter("event_type = 'view'"))
    spark.sql("DROP TABLE IF EXISTS bucketed_events")
    sinks.bucketed(e, "bucketed_events", buckets=4)
    t = spark.table("bucketed_events")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = t.join(t.groupBy("user_id").count(), "user_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert readers.table_or_none(spark, "no_such_table") is None
    events, sessions = readers.events_and_sessions(spark, "bucketed_events", "no_such_table")
    assert events.count() == 200 and sessions is None
    assert "user_id" in sinks.show(t, 2)


def test_generators_are_seeded_and_independent_of_partitions(spark):
    a, b = G.sessions(spark), G.sessions(spark)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.repartition(5).collect()))
    assert a.select("user_session").distinct().count() == 48
    parsed = a.withColumn("event_timestamp", E.X.parse_time("event_time"))
    assert parsed.filter("event_timestamp is null").count() == 0
    found = {r.behavior_segment for r in S.classify(S.behaviour_metrics(parsed)).collect()}
    assert {"bouncer", "power_user"} <= found
    h = G.category_hierarchy(spark)
    assert h.schema == CATEGORY and h.count() == 14 and h.filter("level = 2").count() == 10
    u = G.numbered_users(spark, 500)
    assert u.count() == 500 and u.select("user_segment").distinct().count() == 3
    assert sorted(map(tuple, u.collect())) == sorted(map(tuple, G.numbered_users(spark, 500).repartition(7).collect()))


def test_kafka_settings_and_messages(spark):
    k = readers.Kafka("broker:9092", "clicks")
    assert k.settings()["subscribe"] == "clicks" and k.settings()["startingOffsets"] == "latest"
    assert readers.Kafka.as_messages(spark.range(1), "id").first().asDict() == {"key": "0", "value": '{"id":0}'}


def test_session_settings(spark, monkeypatch):
    monkeypatch.setenv("PATHLOOM_SHUFFLE_PARTITIONS", "4")
    s = session.settings_from_environment()
    assert s.shuffle_partitions == 4 and session.create_session(SessionSettings(shuffle_partitions=4)).conf.get("spark.sql.session.timeZone") == "UTC"
