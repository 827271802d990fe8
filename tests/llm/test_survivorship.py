import datetime as dt

from hirelake.llm import survivorship as V

T0 = dt.datetime(2025, 1, 1)


def test_winners_rank_ties_and_none(spark):
    rows = [("k", "f", 1, 3, T0), ("k", "f", 2, 3, T0 + dt.timedelta(1)), ("k", "f", 3, 3, T0 + dt.timedelta(1)), ("k", "f", 4, 1, T0 + dt.timedelta(9)), ("e", "f", 5, None, T0), ("e", "f", 6, None, T0)]
    got = V.winners(spark.createDataFrame(rows, "key string, field string, ord long, merit long, fetched_at timestamp"), ["merit", "fetched_at", "ord"])
    assert sorted((r.key, r.n_rows, r.ord) for r in got.collect()) == [("e", 2, None), ("k", 4, 3)]


SCHEMA = "ord long, k string, a string, b string, trust int, seen timestamp, vote string"


def test_votes(spark):
    day = dt.timedelta(days=1)
    rows = [
        (1, "x", "Acme", None, 1, T0, "c"), (2, "x", "acme ", " ", 1, T0 - day, "c"), (3, "x", "Other", "v", 1, T0, "c"),  # two votes beat one; the newest form is kept
        (4, "y", "old", "1", 1, T0 - 300 * day, "c"), (5, "y", "new", "1", 1, T0, "c"),  # decay
        (6, "z", "low", None, 1, T0, "c"), (7, "z", "high", None, 4, T0 - day, "c"),  # trust
        (8, None, "q", "q", 1, T0, "c"),
    ]
    got = V.survivors(spark.createDataFrame(rows, SCHEMA), "k", ["a", "b"], "trust", "seen", "ord")
    assert sorted((r.k, r.n_rows, r.a, r.b) for r in got.collect()) == [("x", 3, "Acme", "v"), ("y", 2, "new", "1"), ("z", 2, "high", None)]
    assert V.survivors(spark.createDataFrame([], SCHEMA), "k", ["a", "b"], "trust", "seen", "ord").count() == 0


def test_source_lists(spark):
    entry = lambda s, u, d: (s, u, d)
    rows = [
        (1, [entry("a", "https://x/1", "2025-01-01"), entry(" A ", "https://x/2", "2025-01-02"), entry("b", "/rel", "2025-01-01"), entry("", "https://x/3", "2025-01-01")]),
        (2, [entry("a", "https://x/1", "31/12/2024"), entry("b", "http://y", "2 days ago"), entry(None, None, None)]),
        (3, [entry("a", "https://x/1", "TBC"), entry("b", "nan", "2025-01-01")]),
        (4, []),
        (5, None),
    ]
    df = spark.createDataFrame([(o, r, "UTC", "en-IE", T0) for o, r in rows], "ord long, raw_sources array<struct<source:string,url:string,date_posted:string>>, time_zone string, locale string, fetched_at timestamp")
    boards = spark.createDataFrame([("a", "en-US", "UTC"), ("b", "en-IE", "UTC")], "board string, locale string, time_zone string")
    assert sorted((r.ord, r.merit) for r in V.source_list_merit(df, boards).collect()) == [(1, 1), (2, 1)]


def test_sql(spark):
    from hirelake.llm import catalog
    from oracle import connect, differences

    sf = "/root/testdata/sf0.001"
    for name, sql in catalog.oracle_sql().items():
        mine, theirs, extra, missing = differences(catalog.queries()[name](spark, sf), connect(sf), sql)
        assert (extra, missing) == ([], []) and mine == theirs
