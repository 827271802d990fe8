"""Calls and step times of a search, collected by threads and handed to Spark as tables."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "step string, provider string, model string, tokens_in bigint, tokens_out bigint, elapsed double"


class Telemetry:
    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self.lock:
            self.calls: list[tuple] = []
            self.steps: list[tuple] = []

    def call(self, step: str, provider: str, model: str, tokens_in: int, tokens_out: int, elapsed: float) -> None:
        """One call of a model; a call without the name of a step is not kept."""
        if step:
            with self.lock:
                self.calls.append((step, provider, model, tokens_in, tokens_out, float(elapsed)))

    @contextmanager
    def timer(self, step: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            with self.lock:
                self.steps.append((step, time.monotonic() - began))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(calls, steps) as they are now."""
        with self.lock:
            calls, steps = list(self.calls), list(self.steps)
        return spark.createDataFrame(calls, CALLS), spark.createDataFrame(steps, "step string, elapsed double")


def call_totals(calls: DataFrame) -> DataFrame:
    """One row: tokens in and out of all calls."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.agg(total("tokens_in"), total("tokens_out"), F.count("*").alias("n"))
