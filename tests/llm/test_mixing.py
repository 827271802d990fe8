import itertools
import random

from hirelake.llm.mixing import min_cost_flow, mixed, reachable_total
from hirelake.llm.tokens import DEFAULT_DIR

PATH = f"{DEFAULT_DIR}/byte_bpe_50k.json"


def test_flow_spreads_repetition():
    flow = min_cost_flow({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 150, "b": 60}, {"a": 2, "b": 3})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 150 and sum(v for (_, s), v in flow.items() if s == "b") == 60
    assert flow[("a",), "a"] <= 200 and flow[("b",), "b"] <= 30
    # 210 tokens from 160: with every text used once first, 50 are second laps
    assert sum(flow.values()) == 210


def test_reachable_total():
    assert reachable_total({("a",): 100, ("b",): 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}) in range(199, 203)
    assert reachable_total({("a",): 100}, {"a": 0.5, "gone": 0.5}, {"a": 1, "gone": 1}) in range(198, 203)
    assert reachable_total({}, {"a": 1.0}, {"a": 1}) == 0


def test_frame(spark):
    docs = [(i, f"text number {i} of source one", "One", "c") for i in range(300)] + [(1000 + i, f"words {i} of two", "two ", "c") for i in range(20)]
    docs += [(2000, "shared text", "one", "c"), (2001, "shared text", "two", "c"), (2002, None, "one", "c"), (2003, " ", "one", "c"), (2004, "x", None, "c"), (2005, "y", "other", "c")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, pattern string")
    targets = spark.createDataFrame([("one", 0.5, 1), ("two", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeat int")
    chosen, shares = mixed(docs, targets, PATH)
    share = {r.source: r for r in shares.collect()}
    assert share["gone"].tokens == 0 and share["gone"].shortfall_tokens > 0
    assert abs(share["one"].tokens / share["two"].tokens - 0.5 / 0.4) < 0.08
    rows = chosen.collect()
    caps = {"one": 1, "two": 3}
    assert all(1 <= r.repeats <= caps[r.source] for r in rows) and len({(r.doc_id, r.source) for r in rows}) == len(rows)
    assert not {r.doc_id for r in rows} & {2001, 2002, 2003, 2004, 2005}
    again = mixed(docs, targets, PATH)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mixed(docs.limit(0), targets, PATH)[0].count() == 0


def test_more_patterns_than_allowed(spark, monkeypatch):
    from hirelake.llm import mixing

    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    names = ["a", "b", "c", "d"]
    docs, i = [], 0
    for mask in range(1, 16):
        for k in range(3 + mask % 5):
            for j, name in enumerate(names):
                if mask >> j & 1:
                    docs.append((i, f"pattern {mask} text {k} of some words", name, ""))
                    i += 1
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, pattern string")
    targets = spark.createDataFrame([(n, 0.25, 1) for n in names], "source string, target_share double, max_repeat int")
    chosen, shares = mixed(docs, targets, PATH)
    rows = chosen.collect()
    assert len({(r.doc_id, r.source) for r in rows}) == len(rows) and all(r.repeats == 1 for r in rows)
    assert all(r.shortfall_tokens <= 12 and abs(r.share - 0.25) < 0.05 for r in shares.collect())


def test_every_pattern_serves_all_its_sources(spark, monkeypatch):
    from hirelake.llm import mixing

    names, size = ["a", "b", "c", "d"], {}
    docs, i = [], 0
    for mask in range(1, 16):
        for k in range(3 + mask % 5):
            for j, name in enumerate(names):
                if mask >> j & 1:
                    docs.append((i, f"pattern {mask} text {k} of some words", name))
                    size[name] = size.get(name, 0) + 1
                    i += 1
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.1, 1), ("b", 0.2, 2), ("c", 0.3, 3), ("d", 0.4, 1), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    whole = [sorted(map(tuple, frame.drop("share", "target_share").where("source is not null").collect())) for frame in mixed(docs, targets, PATH)]
    per_text = {t / size[s] for s, _, t, _, _ in whole[1]}
    assert len(per_text) == 1  # all texts are of one length, and each counts for every source it came from
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    assert [sorted(map(tuple, frame.drop("share", "target_share").where("source is not null").collect())) for frame in mixed(docs, targets, PATH)] == whole


def _price(supply, flow):
    laps = lambda x, n: sum(min(n, x - n * r) * r for r in range(x // n + 1) if x > n * r)
    return sum(sum(laps(x, n) for x in xs) + laps(sum(xs), n) for p, n in supply.items() for xs in [[flow[p, s] for s in p]])


def test_least_price_of_all_flows(monkeypatch):
    from hirelake.llm import mixing

    for seed in range(12):
        rnd = random.Random(seed)
        supply = {p: rnd.randint(1, 3) for p in [("a", "b"), ("b", "c"), ("a",), ("c",)]}
        laps = {s: rnd.randint(1, 3) for s in "abc"}
        quota = {s: rnd.randint(1, 8) for s in "abc"}
        pairs = [(p, s) for p in supply for s in p]
        reach = {s: min(quota[s], sum(supply[p] * laps[s] for p, t in pairs if t == s)) for s in "abc"}
        best = min(
            _price(supply, flow)
            for x in itertools.product(*(range(min(supply[p] * laps[s], quota[s]) + 1) for p, s in pairs))
            if all(sum(n for n, (_, t) in zip(x, pairs) if t == s) == reach[s] for s in "abc")
            for flow in [dict(zip(pairs, x))]
        )
        for most in (1, 4096):
            monkeypatch.setattr(mixing, "MAX_PATTERNS", most)
            flow = min_cost_flow(supply, quota, laps)
            assert _price(supply, flow) == best and {s: sum(n for (_, t), n in flow.items() if t == s) for s in "abc"} == reach


def test_flow_over_more_patterns_than_one_matrix_holds():
    names = "abcdefghijklm"
    supply = {tuple(s for j, s in enumerate(names) if mask >> j & 1): 1 + mask * 7 % 50 for mask in range(1, 1 << 13)}
    laps = {s: 1 + j % 3 for j, s in enumerate(names)}
    share = {s: (1 + j % 4) / 30 for j, s in enumerate(names)}
    total = reachable_total(supply, share, laps)
    flow = min_cost_flow(supply, {s: int(total * w) for s, w in share.items()}, laps)
    assert len(supply) > 4096 and all(sum(n for (_, t), n in flow.items() if t == s) == int(total * w) for s, w in share.items())
    assert all(0 <= n <= supply[p] * laps[s] for (p, s), n in flow.items())
    tokens = min(sum(n for p, n in supply.items() if s in p) * laps[s] / w for s, w in share.items())
    assert tokens * (1 - 2e-5) - 2 <= total <= tokens + 1
