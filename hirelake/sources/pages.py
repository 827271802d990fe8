"""Pages and title markets behind a call that a caller provides, with a rate limit and retries inside the reader."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import predicates as P

STORED = 15_000


class Unavailable(Exception):
    """A source that asks to be called again later (HTTP 429 or 503)."""


class RateLimiter:
    """At least ``gap`` seconds between two calls of all threads of a process."""

    def __init__(self, gap: float = 1.2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep = gap, clock, sleep
        self.lock, self.free = threading.Lock(), float("-inf")

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
        if at > now:
            self.sleep(at - now)


def retried(call: Callable, retries: int = 2, limiter: RateLimiter | None = None, sleep: Callable[[float], None] = time.sleep, default: object = None) -> object:
    """The result of ``call``; called again up to ``retries`` times where it is unavailable, after 2, 4, ... seconds. Any other failure, and
    one that lasts, gives ``default``."""
    for n in range(retries + 1):
        if limiter:
            limiter.wait()
        try:
            return call()
        except Unavailable:
            if n < retries:
                sleep(2.0 ** (n + 1))
        except Exception:  # noqa: BLE001 - a broken source has no rows
            return default
    return default


def scan_titles(spark: SparkSession, keywords: list[str], countries: list[str], fetch: Callable[[str, str], list[str]], gap: float = 1.2, page: int = 50) -> DataFrame:
    """(title, n): how often each title stands on the first page of each keyword in each country.

    ``fetch(keyword, country)`` gives titles. All calls go through one task, so that one rate limit holds for them; empty titles go.
    """
    asked = spark.createDataFrame([(k, c) for k in keywords for c in countries], "keyword string, country string")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        limiter = RateLimiter(gap)
        for pdf in batches:
            titles = [t for k, c in zip(pdf["keyword"], pdf["country"], strict=True) for t in (retried(lambda k=k, c=c: fetch(k, c), limiter=limiter) or [])[:page] if t]
            yield pd.DataFrame({"title": titles})

    return asked.coalesce(1).mapInPandas(run, "title string").groupBy("title").agg(F.count("*").alias("n"))


def with_pages(df: DataFrame, url: str, fetch: Callable[[str], str | None], out: str = "page") -> DataFrame:
    """``df`` with the text behind ``url``: its first 15,000 characters; '' where the fetch fails or the page asks for verification."""
    kept = df.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{out}` string"

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(**{out: [(retried(lambda u=u: fetch(u)) or "")[:STORED] if u else "" for u in pdf[url]]})[[*kept, out]]

    return df.mapInPandas(run, schema).withColumn(out, F.when(P.is_verification_page(F.col(out)), "").otherwise(F.col(out)))


def link_states(df: DataFrame, url: str, expires: str, fetch: Callable[[str], str | None]) -> DataFrame:
    """(url, state) of the rows without an expiry: 'fetch_failed', 'posting_closed' or 'ok', each url once."""
    asked = df.where(F.coalesce(F.col(expires).cast("string"), F.lit("")) == "").select(F.col(url).alias("url")).where("url is not null").distinct()
    return with_pages(asked, "url", fetch).select("url", P.link_state(F.col("page")).alias("state"))
