"""Queries that must use every row and every written form, against values worked out by hand."""

import datetime as dt

import pytest

from hirelake import catalog
from hirelake.operators import store as K

UTC = dt.timezone.utc
RECENT, OLD = dt.datetime(2025, 6, 29, tzinfo=UTC), dt.datetime(2025, 3, 1, tzinfo=UTC)
SCHEMA = """ord long, dedup_key string, title string, company string, location string, description_snippet string, url string,
date_posted string, sources array<string>, raw_sources array<struct<source: string, url: string, date_posted: string>>, fetched_at timestamp,
expires_at string, is_complete boolean, assessment struct<score: int, is_relevant: boolean, matched_keywords: array<string>>"""
BOARDS = [("ie.example", "en-IE", "Europe/Dublin"), ("us.example", "en-US", "America/New_York"), ("au.example", "en-AU", "Australia/Sydney")]


def row(ord, **more):
    base = dict.fromkeys(part.split()[0] for part in SCHEMA.replace("\n", " ").split(", ") if ":" not in part) | {
        "dedup_key": f"k{ord}", "title": f"Data Nurse {ord}", "company": f"Firm {ord}", "description_snippet": "python", "url": f"https://x.example/{ord}",
        "sources": ["ie.example"], "raw_sources": [], "fetched_at": RECENT, "is_complete": True, "assessment": None,
    }
    return base | {"ord": ord} | more


@pytest.fixture
def store(spark, tmp_path):
    def write(rows):
        from pyspark.sql.types import _parse_datatype_string

        schema = _parse_datatype_string(SCHEMA)
        spark.createDataFrame([tuple(r[f] for f in schema.names) for r in rows], schema).write.parquet(f"{tmp_path}/job_cache.parquet")
        spark.createDataFrame(BOARDS, "board string, locale string, time_zone string").write.parquet(f"{tmp_path}/board_list.parquet")
        spark.createDataFrame([], "session_key string, created_at timestamp").write.parquet(f"{tmp_path}/search_sessions.parquet")
        spark.createDataFrame([], "visit_id long, visited_at timestamp").write.parquet(f"{tmp_path}/url_visits.parquet")
        return lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()

    return write


EXPIRIES = [
    # expires_at, board, fetched_at, expired at 2025-07-01 00:00 UTC
    ("2025-06-30T23:59:59Z", "ie.example", RECENT, True),
    ("2025-07-01T00:30:00+01:00", "us.example", RECENT, True),
    ("2025-07-01T00:00:00.5Z", "ie.example", OLD, False),
    ("03/07/2025", "ie.example", OLD, False),
    ("03/07/2025", "us.example", RECENT, True),
    ("07/03/2025", "us.example", OLD, False),
    ("1751328000", "ie.example", OLD, False),
    ("1751327999", "ie.example", RECENT, True),
    ("30 June 2025", "ie.example", RECENT, True),
    ("1 July 2025", "us.example", OLD, False),
    ("1 July 2025", "au.example", RECENT, True),
    ("open until filled", "ie.example", RECENT, False),
    ("open until filled", "ie.example", OLD, True),
    (None, "nowhere.example", RECENT, False),
    ("2025-07-01 00:00:01", "nowhere.example", OLD, False),
]


def test_expiry_in_every_form(store):
    rows = [row(3 * i, expires_at=e, sources=[b], fetched_at=f, assessment=(5, True, [])) for i, (e, b, f, _) in enumerate(EXPIRIES)]
    gone = {3 * i for i, x in enumerate(EXPIRIES) if x[3]}
    live = {3 * i for i in range(len(EXPIRIES))} - gone
    run = store(rows)
    assert {r.ord for r in run("pred_10_expired")} == gone
    assert {r.ord for r in run("l01_recent_live")} == live
    assert {r.ord for r in run("jn01_cached_postings")} == live
    assert {r.reason: r.n for r in run("a02_funnel_totals")} == {"cache_hit": len(live), "pending": len(gone)}
    total = [r for r in run("a03_funnel_by_source") if r.source == "*"][0]
    assert (total.n_in, total.cache_hit) == (len(rows), len(live))
    assert run("snk14_vacuum")[0].jobs == len(gone)


def test_whole_store_and_whole_batch(store):
    rows = [row(i, assessment=(5, True, []) if i % 2 else None, dedup_key=f"k{i // 2}") for i in range(12)]
    run = store(rows)
    assert {r.ord for r in run("jn01_cached_postings")} == {1, 3, 5, 7, 9, 11}
    # a live record without an assessment is assessed anew, and a fresh score takes the place of any older one of its key
    assert {r.reason: r.n for r in run("a02_funnel_totals")} == {"cache_hit": 6, "cache_patch": 6}
    assert {r.ord for r in run("jn01_patched")} == {0, 2, 4, 6, 8, 10}
    assert {r.ord: r.score for r in run("snk09_write_assessments")} == {i: (i - i % 2) % 11 for i in range(12)}


def test_every_step_of_the_funnel(store):
    """Texts that the test tables do not hold: closed postings, too many years, and what becomes of each row."""
    old = {"fetched_at": OLD, "expires_at": "2025-01-01"}
    rows = [
        row(0, **old, description_snippet="python. This job has expired"),
        row(1, **old, description_snippet="python, 12+ years of experience"),
        row(2, **old, description_snippet="python, 9 years experience"),
        row(3, **old, description_snippet="no skill at all"),
        row(4, **old, description_snippet=" \u00a0\n"),
        row(5, **old, title="Principal Data Nurse"),
        row(6, **old, title="Violinist"),
        row(7, assessment=(2, False, [])),
        row(8, assessment=(7, True, [])),
        row(9),
        row(10, description_snippet="nothing"),
        row(11, **old, url="https://x.example/2"),
        row(12, **old, title="  "),
        row(13, **old, company="Firm 2", title="Data Nurse 2 (m/f)"),
    ]
    run = store(rows)
    want = {
        0: ("closed", "closed"), 1: ("exp", "exp"), 2: ("pending", "saved"), 3: ("skill", "skill"), 4: ("no_desc", "no_desc"), 5: ("seniority", "seniority"), 6: ("irrelevant", "irrelevant"),
        7: ("cache_hit", "cache_hit"), 8: ("cache_hit", "saved"), 9: ("cache_patch", "saved"), 10: ("cache_patch", "llm_rejected"), 11: ("dup", "dup"), 12: ("dup", "dup"), 13: ("dup", "dup"),
    }
    assert {r.ord: (r.reason, r.outcome) for r in run("x13_outcomes")} == want
    counts = run("a02_counters")[0]
    assert (counts.prefilter_in, counts.skip_closed, counts.skip_exp, counts.cache_hit, counts.cache_patch, counts.llm_assessed, counts.llm_rejected, counts.saved) == (14, 1, 1, 2, 2, 3, 1, 3)
    total = [r for r in run("a03_funnel_by_source") if r.source == "*"][0]
    # of a source only its own new rows count as saved or rejected
    assert (total.n_in, total.saved, total.llm_rejected) == (14, 1, 0)
    assert [r.ord for r in run("pred_03_more_years")] == [1] and [r.ord for r in run("pred_04_closed")] == [0] and [r.ord for r in run("pred_20_possibly_closed")] == [0]
    assert {r.ord: r.state for r in run("pred_23_link_state")} == {7: "ok", 8: "ok", 9: "ok", 10: "ok"}
    assert run("l12_source_lines")[0].line == "Source [ie.example]: 14 in, 1 saved (dup=3, seniority=1, irrelevant=1, cache_hit=2, no_desc=1, closed=1, exp=1, skill=1)"


def test_missing_keys_and_inactive_pages(spark, store):
    run = store([row(0, dedup_key="known", description_snippet="Sorry, this role is no longer available")])
    assert [r.ord for r in run("pred_05_inactive")] == [0]
    assert K.without_keys(spark.createDataFrame([("known",), ("gone",)], "dedup_key string"), spark.createDataFrame([("known",)], "dedup_key string"), "dedup_key").collect() == [("gone",)]


def test_saving_row_by_row(spark):
    """Against the loop: sources joined in order, entries of new sources only, the last expiry and assessment, all else of the first."""
    import random

    rng, rows = random.Random(1), []
    for i in range(60):
        src = [rng.choice("abcd") for _ in range(rng.randrange(4))]
        rows.append((i, rng.choice(["k1", "k2", "k3", f"own{i}", None]), f"t{i}", src, [(rng.choice("abcd"), f"u{i}{n}", None) for n in range(rng.randrange(4))], rng.choice([None, f"e{i}"]), rng.choice([None, i])))
    want = {}
    for i, key, title, src, raw, exp, score in rows:
        if key is None:
            continue
        if key not in want:
            want[key] = [i, title, list(src), list(raw), exp, score]
            continue
        w = want[key]
        names = {e[0] for e in w[3]}
        w[2] = list(dict.fromkeys(w[2] + src))
        w[3] = w[3] + [e for e in raw if e[0] not in names]
        w[4], w[5] = exp or w[4], score if score is not None else w[5]
    schema = "ord long, dedup_key string, title string, sources array<string>, raw_sources array<struct<source:string,url:string,date_posted:string>>, expires_at string, assessment long"
    got = {r.dedup_key: [r.ord, r.title, r.sources, [tuple(e) for e in r.raw_sources], r.expires_at, r.assessment] for r in K.folded(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


DATES = [
    # date_posted, instant in UTC: month first, zone UTC where none is written, relative to fetched_at
    ("2025-06-03", "2025-06-03T00:00:00"),
    ("03/04/2025", "2025-03-04T00:00:00"),
    ("13/04/2025", "2025-04-13T00:00:00"),
    ("31/04/2025", None),
    ("3. März 2025, 13:59 Uhr", "2025-03-03T13:59:00"),
    ("2025-01-02T03:04:05-0500", "2025-01-02T08:04:05"),
    ("April 1, 2025 at 12:00 pm", "2025-04-01T12:00:00"),
    ("1736438364", "2025-01-09T15:59:24"),
    ("2 days ago", "2025-06-27T00:00:00"),
    ("2025-02-30", None),
    ("soon", None),
    ("", None),
    (None, None),
]


def test_lenient_dates_of_every_row(store):
    run = store([row(i, date_posted=v) for i, (v, _) in enumerate(DATES)])
    us = lambda t: t and int((dt.datetime.fromisoformat(t) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    assert {r.ord: r.utc_us for r in run("fn16_lenient_dates")} == {i: us(t) for i, (_, t) in enumerate(DATES)}


def test_sources_of_all_boards(store):
    key = {"company": "Firm", "title": "Data Nurse"}
    boards = ["b.example", "talentquay.example", "a.example", "talentquay.example", None]
    rows = [row(i, sources=[b] if b else None, **key) for i, b in enumerate(boards)]
    run = store([*rows, row(10, sources=["talentquay.example"]), row(11, sources=None)])
    want = dict.fromkeys(range(5), "b.example|talentquay.example|a.example") | {10: "talentquay.example", 11: None}
    assert {r.ord: r.sources for r in run("jn02_own_or_collected")} == want
