"""The search facade, calls behind limits and retries, pluggable scorers, events and telemetry."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from hirelake import telemetry
from hirelake.engine import Busy, Engine, discovered_titles
from hirelake.operators import scoring as S
from hirelake.operators import store as K
from hirelake.plans.funnel import Candidate
from hirelake.sources import boards, pages
from hirelake.streaming import postings as stream

POSTING = "ord long, url string, title string, company string, location string, description string, source string, date_posted string"
WHO = Candidate("mid", 10, ["nurse"], ["python"])


def postings(spark):
    rows = [
        (0, "u0", "Data Nurse", "Acme Ltd", "Cork", "python ward", "a", "2025-06-01"),
        (1, "u1", "Data Nurse (remote)", "ACME", "Cork", "python", "b", "2025-06-02"),
        (2, "u2", "Night Nurse", "Bee", None, "python. This job has expired", "a", None),
        (3, "u3", "Day Nurse", "Cee", "x", "python, 30 years of experience", "b", None),
        (4, "u4", "Chef", "Dee", "x", "python", "a", None),
        (5, "u5", "Old Nurse", "Eee", "x", "python and 12+ years exp", "b", None),
        (6, "u6", "Ward Nurse", "Fee", "x", "python ward", "b", None),
    ]
    return spark.createDataFrame(rows, POSTING)


def test_search(spark):
    now = ["2025-07-01 00:00:00"]
    seen, scans = [], []

    def scan(roles, location):
        scans.append(roles)
        return postings(spark)

    e = Engine(spark, scan, ["a", "b"], lambda: now[0])
    keys, counts = e.search(["Nurse"], "Cork", WHO, on_job=seen.append)
    assert keys == ["acme|data nurse", "fee|ward nurse"] == seen
    assert (counts["prefilter_in"], counts["skip_dup"], counts["skip_closed"], counts["skip_exp"], counts["skip_irrelevant"], counts["saved"]) == (7, 1, 1, 2, 1, 2)
    job = e.job("acme|data nurse").first()
    assert job.sources == ["a", "b"] and [r.url for r in job.raw_sources] == ["u0", "u1"] and job.assessment.score == 4 and job.assessment.is_relevant
    assert [(r.url, r.reason) for r in e.tables["failed_urls"].collect()] == [("u2", "posting_closed")]
    # a fresh session answers without a scan, an old one does not; then the records are known
    assert e.search(["Nurse"], "Cork", WHO) == (keys, {"saved": 2}) and len(scans) == 1
    now[0] = "2025-07-02 12:00:00"
    again, counts = e.search(["Nurse"], "Cork", WHO)
    assert again == keys and counts["cache_hit"] == 2 and counts["llm_assessed"] == 0 and len(scans) == 2
    assert e.tables["sessions"].count() == 1
    assert [(r.id, r.jobs_found, json.loads(r.funnel)["saved"]) for r in e.tables["stats"].orderBy("id").collect()] == [(1, 2, 2), (2, 2, 2)]
    assert {step for step, _ in e.telemetry.steps} == {"scan", "funnel", "store"}
    assert e.live_jobs(keys[:1]).count() == 1 and e.delete(["acme|data nurse", "gone"]) == 1
    now[0] = "2025-07-20 00:00:00"
    assert e.live_jobs().count() == 0 and e.vacuum() == 2
    e.clear()
    assert {n: t.count() for n, t in e.tables.items()} == {"jobs": 0, "sessions": 0, "failed_urls": 0, "stats": 2}


def test_one_search_at_a_time_and_a_model_behind_a_call(spark):
    e = Engine(spark, lambda roles, location: postings(spark), ["a"], lambda: "2025-07-01 00:00:00", call=lambda batch: [{"relevant": "Ward" in t, "score": 9} for t, _ in batch])
    with e.alone(), pytest.raises(Busy):
        e.search(["Nurse"], "Cork", WHO)
    keys, _ = e.search(["Nurse"], "Cork", WHO)
    assert keys == ["fee|ward nurse"] and e.job("acme|data nurse").first().assessment.is_relevant is False


def test_patched_record(spark):
    e = Engine(spark, lambda roles, location: postings(spark).where("ord = 0"), ["a"], lambda: "2025-07-01 00:00:00")
    row = (7, "old|key", "t", "c", "l", "python", "u0", None, ["x"], [], dt.datetime(2025, 6, 29), None, True, None)
    e.tables["jobs"] = spark.createDataFrame([row], e.tables["jobs"].schema)
    keys, counts = e.search(["Nurse"], "Cork", WHO)
    assert keys == ["old|key"] and counts["cache_patch"] == 1 and e.job("old|key").first().assessment.score == 4


def test_limits_and_retries():
    clock, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    limiter = pages.RateLimiter(1.2, lambda: clock[0], sleep)
    for _ in range(3):
        limiter.wait()
    assert slept == [1.2, 1.2]
    calls, slept = [], []

    def flaky(fails, error=pages.Unavailable):
        def call():
            calls.append(1)
            if len(calls) <= fails:
                raise error
            return "ok"

        return call

    assert pages.retried(flaky(2), sleep=slept.append) == "ok" and slept == [2.0, 4.0]
    calls.clear()
    assert pages.retried(flaky(9), sleep=slept.append, default=[]) == [] and len(calls) == 3
    calls.clear()
    assert pages.retried(flaky(1, ValueError), sleep=slept.append, default=[]) == [] and len(calls) == 1


def test_titles_and_pages(spark):
    def fetch(keyword, country):
        if keyword == "broken":
            raise OSError
        return ["Nurse", "", None, f"{keyword} {country}"] + ["late"] * 60

    got = {r.title: r.n for r in pages.scan_titles(spark, ["data", "broken"], ["us", "gb"], fetch, gap=0).collect()}
    assert got == {"Nurse": 2, "data us": 1, "data gb": 1, "late": 92}
    texts = {"good": "w " * 9000, "check": "Cloudflare Ray ID " * 20, "gone": "Sorry, this role is no longer available. " * 9}
    df = spark.createDataFrame([(u, e) for u, e in (("good", None), ("check", ""), ("gone", None), ("none", None), (None, None), ("good", "2025"))], "url string, expires string")
    assert {r.url: len(r.page) for r in pages.with_pages(df, "url", texts.get).collect()} == {"good": 15000, "check": 0, "gone": 369, "none": 0, None: 0}
    assert {r.url: r.state for r in pages.link_states(df, "url", "expires", texts.get).collect()} == {"good": "ok", "check": "fetch_failed", "gone": "posting_closed", "none": "fetch_failed"}
    groups = spark.createDataFrame([("Data Nurse", 5), ("data nurse", 3), ("Nurse, Cook & Clerk", 9), ("Chef", 7), ("Nurse", 1)], "title string, n long")
    assert [tuple(r) for r in discovered_titles(groups, ["nurse", "data"]).collect()] == [(1, "data nurse", 8)]


def test_calls_that_fail_or_come_back_short(spark):
    def call(batch):
        if any("bad" in t for t, _ in batch):
            raise RuntimeError
        return [{"relevant": False, "reason": "no", "score": 1, "matched_keywords": ["k"]}] * (len(batch) - 1) + [{"relevant": None}] * 3

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}", "x", "clash") for i in range(20)], "ord long, title string, text string, slots string")
    got = {r.ord: (r.batch, r.slot, r.relevant, r.score) for r in S.assessed_by(call, rows, "ord", "title", "text").collect()}
    assert len(got) == 20 and all(got[i] == (0, i + 1, True, 0) for i in range(8))
    assert all(got[i] == (1, i - 7, False, 1) for i in range(8, 15)) and got[15] == (1, 8, True, 0) and got[19] == (2, 4, True, 0)
    cards = spark.createDataFrame([(1, 0.6), (2, 0.5), (9, 1.0)], "ord long, score double")
    assert sorted(r.ord for r in S.kept_cards(rows, "ord", lambda _: cards).collect()) == [1, 9]
    assert S.kept_cards(rows, "ord", None).count() == 20 and S.kept_cards(rows, "ord", lambda _: 1 / 0).count() == 20


def test_two_boards(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second.jsonl"
    first.mkdir()
    line = lambda url, title, text, company="A": json.dumps({"title": title, "job_url": url, "company": company, "description": text})
    (first / "1.jsonl").write_text("\n".join([line("u1", "Data Nurse", "<p>a&amp;b</p>"), line("u2", "Nurse", "x")]), encoding="utf-8")
    (first / "2.jsonl").write_text("\n".join([line("u3", "Nurse", "y"), line("u1", "Nurse", "again")]), encoding="utf-8")
    second.write_text("\n".join([line("u2", "Nurse", "other"), line("u9", "Nurse", "# a\n\n\n\n<b>")]), encoding="utf-8")
    got, counts = boards.scan_boards(spark, str(first), str(second), ["nurse"], "Ireland, Cork", limits=(3, 5))
    assert {(r.url, r.source, r.description) for r in got.collect()} == {("u1", "first", "a&b"), ("u2", "first", "x"), ("u3", "first", "y"), ("u9", "second", "# a\n\n<b>")}
    assert counts == {"scraped_first": 3, "scraped_second": 2, "scraped_total": 4}
    assert boards.scan_boards(spark, str(first), str(second), ["nurse"], "remote work", limits=(0, 5))[1] == {"scraped_first": 0, "scraped_second": 0, "scraped_total": 0}
    assert [boards.second_place(x) for x in ("Ireland", "uk", "", "cork city", "Remote")] == ["Dublin, Ireland", "London, United Kingdom", "Dublin, Ireland", "Cork City", ""]


def test_telemetry(spark):
    t = telemetry.Telemetry()
    threads = [threading.Thread(target=t.call, args=("assess", "p", "m", 10, i, 0.5)) for i in range(8)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t.call("", "p", "m", 999, 999, 1)
    with t.timer("scan"):
        pass
    calls, steps = t.tables(spark)
    assert telemetry.call_totals(calls).first().asDict() == {"tokens_in": 80, "tokens_out": 28, "n": 8} and steps.count() == 1
    t.reset()
    assert telemetry.call_totals(t.tables(spark)[0]).first().asDict() == {"tokens_in": 0, "tokens_out": 0, "n": 0}


def test_events_and_emission(spark, tmp_path):
    clock = [0.0]
    sleep = lambda s: clock.__setitem__(0, clock[0] + s)
    run = lambda until, fail=None: [k for k, _ in stream.events(lambda: clock[0] < until, lambda: fail if clock[0] >= 5 and fail else None, 15, 60, 1, lambda: clock[0], sleep)]
    assert run(40) == ["keepalive", "keepalive", "done"]
    clock[0] = 0
    assert run(40, "broken") == ["error"]
    clock[0] = 0
    assert run(1e9)[-1] == "timeout" and clock[0] == 120
    spark.createDataFrame([("k1",), ("k2",)], "key string").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    stream.emit_keys(spark.readStream.schema("key string").parquet(f"{tmp_path}/in"), "key", seen.append, f"{tmp_path}/state").awaitTermination()
    assert seen == ["k1", "k2"]


def test_store_forms(spark):
    old = spark.createDataFrame([("k", "t")], "dedup_key string, title string")
    schema = spark.createDataFrame([], "dedup_key string, title string, raw_sources array<string>, is_complete boolean").schema
    assert K.conformed(old.withColumn("more", F.lit(1)), schema, {"is_complete": True}).collect() == [("k", "t", None, True)]
    kind = "title string, company string, location string, url string, description string, date_posted string, sources array<string>, raw_sources array<struct<source:string,url:string,date_posted:string>>, is_complete boolean"
    rows = [("T (x)", "Co Ltd", None, "https://www.a.example/1", None, None, None, None, None), ("T", "B", "l", "nonsense", "d", "2025", [], [], False), ("T", "C", "l", "https://b.example", "d", "2025", ["s", "q"], None, True)]
    got = K.normalised_jobs(spark.createDataFrame(rows, kind)).collect()
    assert [(r.dedup_key, r.sources, [tuple(e) for e in r.raw_sources], r.is_complete) for r in got] == [
        ("|t", ["a.example"], [("a.example", "https://www.a.example/1", "")], True),
        ("b|t", [], [], False),
        ("c|t", ["s", "q"], [("s", "https://b.example", "2025")], True),
    ]
