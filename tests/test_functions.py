"""Hand-built cases of the text functions, predicates and ordered rules."""

import random

import pytest
from pyspark.sql import functions as F

from hirelake.functions import predicates as P
from hirelake.functions import text as T
from hirelake.operators import dedup as D
from hirelake.operators import store as K


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "make, value, want",
    [
        (T.company_key, "Acme, Inc.", "acme"), (T.company_key, "The Group Ltd", "the"), (T.company_key, "Co", ""), (T.company_key, None, ""), (T.company_key, "Señor Ágora AG", "señor ágora"),
        (T.title_key, "Data Engineer (Remote) - Team A", "data engineer"), (T.title_key, "Full-Stack Developer", "full"), (T.title_key, None, ""),
        (T.clean_location, "DUBLIN 2, D, IE", "Dublin 2, Ireland"), (T.clean_location, "Paris, FR", "Paris, Ireland"), (T.clean_location, "", ""), (T.clean_location, None, ""),
        (T.deadline, "Apply by: 30 April 2026 at noon", "30 April 2026"), (T.deadline, "no date", None), (T.deadline, None, None),
        (T.domain, "https://www.a.example:80/x", "a.example:80"), (T.domain, "nonsense", ""), (T.domain, None, ""),
        (T.html_text, "<p>a</p><p>b<br>c</p>", "a\nb\nc"), (T.json_in_text, "```json\n{\"a\": {\"b\": 1}}\n```", '{"a": {"b": 1}}'), (T.file_name, "a/b c" + "x" * 60, "a_b c" + "x" * 45),
        (T.present, " nan ", ""), (T.present, None, ""), (T.title_case, "o'neill-smith CO", "O'Neill-Smith Co"),
        (lambda c: T.repaired_sources(c), '["a", {"source":"b"}]', ["a", "b"]),
        (lambda c: T.required_years(c), "3-5 years experience, 10+ years of exp", ["5", "10"]),
        (P.closed, "This job has expired", True), (P.closed, "no longer accepting", True), (P.closed, "open now", False), (P.closed, None, False),
        (P.inactive_page, "Sorry, this job is no longer available", True), (P.inactive_page, "apply now", False),
        (P.is_verification_page, "x" * 199, True), (P.is_verification_page, "cloudflare " + "x" * 250, False), (P.is_verification_page, "Cloudflare Ray ID " + "x" * 250, True), (P.is_verification_page, None, True),
        (lambda c: P.asks_more_years(c, 5), "5+ years of experience", False), (lambda c: P.asks_more_years(c, 4), "5+ years of experience", True), (lambda c: P.asks_more_years(c, 4), "9" * 30 + " years experience", True),
        (lambda c: P.suits_level(c, "new_grad"), "Sr. Engineer", False), (lambda c: P.suits_level(c, "junior"), "Engineer II", True), (lambda c: P.suits_level(c, "senior"), "Engineer II", False),
        (lambda c: P.suits_level(c, "mid"), "Engineer III", True), (lambda c: P.suits_level(c, "mid"), "Graduate Programme", False), (lambda c: P.suits_level(c, "unknown"), None, True),
        (lambda c: P.relevant(c, ["node.js"]), "Node.js Developer", False), (lambda c: P.relevant(c, []), None, True),
        (lambda c: P.noisy_title(c, F.lit(2)), "A, B & C", True), (lambda c: P.noisy_title(c, F.lit(2)), "a b c d e f g h i", True), (lambda c: P.noisy_title(c, F.lit(1)), "Data Analyst", True), (lambda c: P.noisy_title(c, F.lit(2)), "Data Analyst", False),
        (lambda c: P.chat_model(c, F.lit(None).cast("string")), "text-embed-1", False), (lambda c: P.chat_model(c, F.lit("Music maker")), "x-1", False), (lambda c: P.chat_model(c, F.lit("Chat")), "x-1", True),
    ],
)
def test_value(spark, make, value, want):
    assert one(spark, value, make) == want


def test_condensed(spark):
    rows = [(["Applied AI Engineer", "AI Engineer", "Data Engineer", "Chef", "Nurse"],), (["Senior Nurse", "nurse", None],), (None,), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "r array<string>").select(T.condensed(F.col("r"))).collect()]
    assert got == [["Chef", "Nurse", "AI Engineer"], ["nurse"], [], []]


def test_rates(spark):
    rows = spark.createDataFrame([(942, 996), (0, 0), (None, None)], "a int, b int")
    assert [r[0] for r in rows.select(T.rate(F.col("a"), F.col("b"))).collect()] == [94.6, 0.0, 0.0]


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_against_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["u1", "u2", "u3", "u4", "", None]), rng.choice(["t", "", None, "s"]), rng.choice("kl")) for i in range(40)]
    urls, keys, want = set(), set(), set()
    for i, url, title, key in rows:
        if not url or url in urls:
            want.add(i)
            continue
        urls.add(url)
        if not (title or "").strip() or key in keys:
            want.add(i)
            continue
        keys.add(key)
    got = D.mark_duplicates(spark.createDataFrame(rows, "ord int, url string, title string, key string")).where("dup")
    assert {r.ord for r in got.collect()} == want


def test_sources_of_keys(spark):
    rows = [(1, "k", "a", "u1", "d"), (2, "k", "b", "u2", None), (3, "k", "a", "u3", "d"), (4, "q", None, None, None)]
    got = {r.key: [(e.source, e.url) for e in r.entries] for r in D.sources_of_keys(spark.createDataFrame(rows, "ord int, key string, source string, url string, date_posted string")).collect()}
    assert got == {"k": [("a", "u1"), ("b", "u2")], "q": [(None, None)]}


def test_numbered_append(spark):
    old = spark.createDataFrame([(7, "a")], "id long, v string")
    new = spark.createDataFrame([(None, f"v{i:03}") for i in range(50)], "id long, v string")
    got = {r.v: r.id for r in K.append_numbered(old, new, "id", "v").collect()}
    assert got == {"a": 7} | {f"v{i:03}": 8 + i for i in range(50)}
