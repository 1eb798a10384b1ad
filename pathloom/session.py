"""Spark sessions for batch and streaming work."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import SparkSession

from pathloom.model import SessionSettings


def create_session(settings: SessionSettings = SessionSettings()) -> SparkSession:
    """A session with adaptive execution; the master of the settings is honoured, and the launcher's where it is None."""
    conf = {
        "spark.sql.session.timeZone": settings.time_zone,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.pathloom.broadcastBytes": str(settings.broadcast_bytes),
        "spark.pathloom.trigger": settings.trigger,
        **({"spark.pathloom.tables": settings.tables_root} if settings.tables_root else {}),
    } | dict(settings.extra)
    if settings.shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(settings.shuffle_partitions)
    builder = SparkSession.builder.appName(settings.app_name).config(map=conf)
    return (builder.master(settings.master) if settings.master else builder).getOrCreate()


def create_batch_session(settings: SessionSettings = SessionSettings()) -> SparkSession:
    return create_session(replace(settings, shuffle_partitions=settings.shuffle_partitions or 16))


def create_streaming_session(settings: SessionSettings = SessionSettings()) -> SparkSession:
    """Few state partitions, which a query keeps for life, and state in RocksDB, off the heap."""
    state = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return create_session(replace(settings, shuffle_partitions=settings.shuffle_partitions or 8, extra=(state, *settings.extra)))


def settings_from_environment(prefix: str = "PATHLOOM_") -> SessionSettings:
    env = {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
    known = {k: env[k] for k in ("app_name", "master", "time_zone", "trigger", "tables_root") if k in env}
    numbers = {k: int(env[k]) for k in ("shuffle_partitions", "broadcast_bytes") if k in env}
    return SessionSettings(**known, **numbers)
