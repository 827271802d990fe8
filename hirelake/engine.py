"""A search as one call: session, scan, funnel, assessment, store, session and log, over tables that are replaced, never changed."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import predicates as P
from hirelake.functions import text as T
from hirelake.operators import scoring as S
from hirelake.operators import store as K
from hirelake.operators.dedup import sources_of_keys
from hirelake.plans import funnel
from hirelake.session import cut
from hirelake.telemetry import Telemetry

SESSION = "session_key string, roles array<string>, location string, seniority string, job_dedup_keys array<string>, created_at timestamp"
JOB = (
    "ord bigint, dedup_key string, title string, company string, location string, description_snippet string, url string, date_posted string, sources array<string>, "
    "raw_sources array<struct<source: string, url: string, date_posted: string>>, fetched_at timestamp, expires_at timestamp, is_complete boolean, assessment struct<score: int, is_relevant: boolean>"
)
STATS = "id bigint, created_at timestamp, location string, roles array<string>, elapsed double, jobs_found bigint, funnel string"
SESSION_HOURS = 24


class Busy(RuntimeError):
    """Another search is running."""


class Engine:
    """``scan(roles, location)`` gives postings (ord, url, title, company, location, description, source, date_posted), at most one search's worth.

    Tables are plain DataFrames in ``tables``; every change puts a new one, cut from its lineage, in place of the old.
    """

    def __init__(self, spark: SparkSession, scan: Callable[[list[str], str], DataFrame], sources: list[str], now: Callable[[], str], call: Callable | None = None) -> None:
        self.spark, self.scan, self.sources, self.now, self.call = spark, scan, sources, now, call
        self.tables = {name: spark.createDataFrame([], schema) for name, schema in (("jobs", JOB), ("sessions", SESSION), ("failed_urls", "url string, reason string"), ("stats", STATS))}
        self.telemetry, self._one = Telemetry(), threading.Lock()

    @contextmanager
    def alone(self) -> Iterator[None]:
        """One search at a time; a second one is refused, not queued."""
        if not self._one.acquire(blocking=False):
            raise Busy("a search is running")
        try:
            yield
        finally:
            self._one.release()

    def _put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = cut(df)

    def _time(self):
        return F.to_timestamp(F.lit(self.now()))

    def session(self, key: str) -> list[str] | None:
        """The keys that a fresh session of this search stored; an old one is as good as none."""
        fresh = F.unix_micros(self._time()) - F.unix_micros("created_at") <= SESSION_HOURS * 3_600_000_000
        row = self.tables["sessions"].where((F.col("session_key") == key) & fresh).first()
        return None if row is None else list(row.job_dedup_keys)

    def search(self, roles: list[str], location: str, who: funnel.Candidate, on_job: Callable[[str], None] | None = None, refresh: bool = False) -> tuple[list[str], dict]:
        """(keys, counters) of a search. A fresh session answers at once, with ``saved`` as its only counter. Keys are those of one search."""
        with self.alone():
            began = time.monotonic()
            self.telemetry.reset()
            row = self.spark.range(1).select(T.session_key(F.array(*(F.lit(r) for r in roles)).cast("array<string>"), F.lit(location), F.lit(who.level), self.sources).alias("k")).first()
            known = None if refresh else self.session(row.k)
            if known is not None:
                for key in known if on_job else ():
                    on_job(key)
                return known, {"saved": len(known)}
            with self.telemetry.timer("scan"):
                postings = cut(self.scan(roles, location))
            with self.telemetry.timer("funnel"):
                rows = self._assessed(postings, who)
            counters = funnel.totals(rows).first().asDict()
            keys = [r.k for r in rows.where("outcome = 'saved'").groupBy(F.coalesce("cached_key", "key").alias("k")).agg(F.min("ord").alias("o")).orderBy("o").select("k").collect()]
            with self.telemetry.timer("store"):
                self._save(postings, rows)
            self._store_session(row.k, roles, location, who.level, keys)
            self._log(location, roles, time.monotonic() - began, keys, counters)
            for key in keys if on_job else ():
                on_job(key)
            return keys, counters

    def _assessed(self, postings: DataFrame, who: funnel.Candidate) -> DataFrame:
        jobs = self.tables["jobs"]
        relevant = F.coalesce("assessment.is_relevant", F.lit(True)).alias("relevant")
        cache = jobs.select("ord", "dedup_key", "url", F.col("expires_at").alias("expires_ts"), "fetched_at", F.col("assessment").isNotNull().alias("assessed"), relevant)
        rows = funnel.with_reason(postings, who, cache, self._time())
        rows = funnel.assessed(rows, who, jobs.select("ord", "url", F.col("description_snippet").alias("description")))
        first = jobs.where("url is not null").groupBy("url").agg(F.min_by("dedup_key", "ord").alias("cached_key"))
        rows = cut(rows.join(first, "url", "left").withColumn("cached_key", F.when(F.col("reason").isin("cache_hit", "cache_patch"), F.col("cached_key"))))
        if self.call is None:
            return rows
        asked = rows.where("reason in ('pending', 'cache_patch')")
        said = S.assessed_by(self.call, asked.select("ord", "title", "description"), "ord", "title", "description").select("ord", F.col("relevant").alias("__r"), F.col("score").cast("bigint").alias("__s"))
        verdict = F.when(F.col("__r"), "saved").when(~F.col("__r"), "llm_rejected").otherwise(F.col("outcome"))
        return cut(rows.join(said, "ord", "left").withColumns({"outcome": verdict, "score": F.coalesce("__s", "score")}).drop("__r", "__s"))

    def _save(self, postings: DataFrame, rows: DataFrame) -> None:
        """Assessed new rows are saved with the sources of their key, patched records get their assessment, closed postings are failures."""
        found = sources_of_keys(postings.withColumn("key", T.posting_key(T.strip(F.col("company")), T.strip(F.col("title")))))
        entry = F.transform("entries", lambda e: F.struct(F.coalesce(e["source"], F.lit("unknown")).alias("source"), F.coalesce(e["url"], F.lit("")).alias("url"), F.coalesce(e["date_posted"], F.lit("")).alias("date_posted")))
        said = F.struct(F.col("score").cast("int").alias("score"), (F.col("outcome") == "saved").alias("is_relevant"))
        fresh = rows.where("reason = 'pending'").join(found, "key").withColumns({"raw_sources": entry, "sources": F.transform("entries", lambda e: F.coalesce(e["source"], F.lit("unknown"))), "is_complete": F.lit(True)})
        fresh = K.normalised_jobs(fresh).withColumns({"description_snippet": F.col("description"), "fetched_at": self._time(), "expires_at": F.lit(None).cast("timestamp"), "assessment": said})
        jobs = self.tables["jobs"]
        top = jobs.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("__top"))
        fresh = fresh.crossJoin(F.broadcast(top)).withColumn("ord", F.col("ord") + F.col("__top") + 1)  # one row
        merged = K.upsert_merge(jobs, K.folded(fresh.select(*jobs.columns)))
        patched = rows.where("reason = 'cache_patch'").groupBy(F.col("cached_key").alias("dedup_key")).agg(F.min_by(said, "ord").alias("__said"))
        merged = merged.join(patched, "dedup_key", "left").withColumn("assessment", F.coalesce("__said", "assessment")).select(*jobs.columns)
        names = F.array_distinct(F.concat(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("__more", F.array().cast("array<string>"))))
        more = found.where(F.size("entries") > 1).select(F.col("key").alias("dedup_key"), F.transform("entries", lambda e: F.coalesce(e["source"], F.lit("unknown"))).alias("__more"))
        self._put("jobs", merged.join(more, "dedup_key", "left").withColumn("sources", F.when(F.col("__more").isNotNull(), names).otherwise(F.col("sources"))).select(*jobs.columns))
        closed = rows.where("reason = 'closed'").select("ord", "url", F.lit("posting_closed").alias("reason"))
        failed = self.tables["failed_urls"]
        self._put("failed_urls", K.first_write_wins(failed, closed, "url", "ord").select("url", "reason"))

    def _store_session(self, key: str, roles: list[str], location: str, level: str, keys: list[str]) -> None:
        old = self.tables["sessions"]
        new = self.spark.createDataFrame([(key, roles, location, level, keys)], "session_key string, roles array<string>, location string, seniority string, job_dedup_keys array<string>").withColumn("created_at", self._time())
        o, n = old.alias("o"), new.alias("n")
        own = {c: F.coalesce(f"n.{c}", f"o.{c}") if c in ("job_dedup_keys", "created_at") else F.coalesce(f"o.{c}", f"n.{c}") for c in old.columns}
        self._put("sessions", o.join(n, "session_key", "full_outer").select(*((F.col(c) if c == "session_key" else v).alias(c) for c, v in own.items())))

    def _log(self, location: str, roles: list[str], elapsed: float, keys: list[str], counters: dict) -> None:
        report = F.to_json(F.create_map(*(F.lit(x) for k, v in counters.items() for x in (k, int(v)))))
        new = self.spark.createDataFrame([(1, location, roles, round(elapsed, 1), len(keys))], "at int, location string, roles array<string>, elapsed double, jobs_found bigint")
        new = new.select(F.lit(None).cast("bigint").alias("id"), self._time().alias("created_at"), "location", "roles", "elapsed", "jobs_found", report.alias("funnel"), "at")
        self._put("stats", K.append_numbered(self.tables["stats"].withColumn("at", F.lit(0)), new, "id", "at").drop("at"))

    def job(self, key: str) -> DataFrame:
        return self.tables["jobs"].where(F.col("dedup_key") == key)

    def live_jobs(self, keys: list[str] | None = None) -> DataFrame:
        """Jobs that have not expired, of some keys or all."""
        jobs = self.tables["jobs"].where(~P.expired(F.col("expires_at"), F.col("fetched_at"), self._time()))
        return jobs if keys is None else K.with_keys(jobs, self.spark.createDataFrame([(k,) for k in keys], "dedup_key string"), "dedup_key")

    def delete(self, keys: list[str]) -> int:
        """How many jobs were deleted."""
        before = self.tables["jobs"].count()
        self._put("jobs", K.without_keys(self.tables["jobs"], self.spark.createDataFrame([(k,) for k in keys], "dedup_key string"), "dedup_key"))
        return before - self.tables["jobs"].count()

    def vacuum(self) -> int:
        """How many expired jobs and sessions went."""
        at = F.unix_micros(self._time())
        old = {
            "jobs": F.coalesce(F.col("expires_at") < self._time(), F.unix_micros("fetched_at") < at - 7 * 86_400_000_000),
            "sessions": F.unix_micros("created_at") < at - SESSION_HOURS * 3_600_000_000,
        }
        gone = 0
        for name, condition in old.items():
            before = self.tables[name].count()
            self._put(name, self.tables[name].where(~F.coalesce(condition, F.lit(False))))
            gone += before - self.tables[name].count()
        return gone

    def clear(self, keep: tuple[str, ...] = ("stats",)) -> None:
        self.tables = K.cleared(self.tables, keep)


def discovered_titles(groups: DataFrame, words: list[str], most: int = 5) -> DataFrame:
    """(place, title, n) from counted titles (title, n): noise goes, then the best ``most`` by the scorer."""
    return S.ranked_titles(groups.where(~P.noisy_title(F.col("title"), F.col("n"))).withColumn("title", F.lower("title")).groupBy("title").agg(F.sum("n").alias("n")), words, most)

