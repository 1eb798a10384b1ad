"""Replay of recorded events: chunks in order, a pause after each, and retries. It is paced on purpose and runs on the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame


def chunks(rows: Iterator, n: int) -> Iterator[list]:
    while chunk := list(islice(rows, n)):
        yield chunk


def attempt(action: Callable[[], None], retries: int, sleep=time.sleep, first_wait: float = 0.5) -> None:
    """action, and again after a failure, each time after twice the wait; the last failure is raised."""
    for k in range(retries + 1):
        try:
            return action()
        except Exception:
            if k == retries:
                raise
            sleep(first_wait * 2**k)


def replay(events: DataFrame, send: Callable[[DataFrame], None], order: list[str], chunk_rows: int = 1000, pause_seconds: float = 0.01, retries: int = 3, sleep=time.sleep) -> int:
    """Sends all rows in order, at most chunk_rows at a time; returns how many were sent. One partition is on the driver at once."""
    spark, sent = events.sparkSession, 0
    for chunk in chunks(events.orderBy(*order).toLocalIterator(), chunk_rows):
        batch = spark.createDataFrame(chunk, events.schema)
        attempt(lambda: send(batch), retries, sleep)  # noqa: B023  called at once
        sent += len(chunk)
        sleep(pause_seconds)
    return sent
