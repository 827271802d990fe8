"""Streaming forms of the ordered first-occurrence rules, and events of a running search."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def distinct_stream(stream: DataFrame, keys: list[str], event_time: str, delay: str = "7 days") -> DataFrame:
    """Rows whose keys were not seen within ``delay`` of event time; state expires with the watermark.

    Within a batch which of several rows stays is not fixed; the set of keys that pass equals that of a
    batch run while all input lies within the watermark.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``write`` for each micro-batch until the available input is read."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def emit_keys(stream: DataFrame, key: str, on_job: Callable[[str], None], checkpoint: str) -> StreamingQuery:
    """``on_job`` for each key of each micro-batch, as results come; the keys pass through the driver one by one."""

    def write(df: DataFrame, _: int) -> None:
        for row in df.select(key).toLocalIterator():
            on_job(row[0])

    return each_batch(stream, write, checkpoint)


def events(running: Callable[[], bool], failed: Callable[[], str | None], keepalive: float = 15, deadline: float = 1800, extensions: int = 4, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, step: float = 0.5) -> Iterator[tuple[str, str]]:
    """('keepalive', '') while a search runs, then ('done', ''), ('error', what) or ('timeout', '').

    The deadline is put off up to ``extensions`` times while the search is still running.
    """
    began = said = clock()
    while True:
        if (what := failed()) is not None:
            yield "error", what
            return
        if not running():
            yield "done", ""
            return
        now = clock()
        if now - began >= deadline * (1 + extensions):
            yield "timeout", ""
            return
        if now - said >= keepalive:
            said = now
            yield "keepalive", ""
        sleep(step)
