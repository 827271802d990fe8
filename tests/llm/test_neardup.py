import random
import re

from hirelake.llm import neardup as N

SCHEMA = "ord long, text string, id string, n string"


def brute(rows, least=25, k=3, t=0.5):
    sets = {}
    for o, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if len(w) >= least:
            sets[o] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows, o = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 60, 120, 300]))]
        for edits in (0, 0, 1, 3):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((o, (", " if edits else " ").join(w).upper() if edits == 1 else " ".join(w)))
            o += 1
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, "too short"), (903, "same " * 24), (904, "same " * 25), (905, "same " * 30)]


def test_pairs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(o, t, "clash", "clash") for o, t in rows], SCHEMA)
    got = {(r.ord_a, r.ord_b) for r in N.similar_pairs(df, "ord", "text").collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_classes_and_empty(spark):
    rows = [(i, " ".join(f"a{j}" for j in range(40))) for i in range(5)] + [(9, " ".join(f"b{j}" for j in range(40)))]
    df = spark.createDataFrame([(o, t, "", "") for o, t in rows], SCHEMA)
    got = sorted((r.ord, r.class_id, r.n_links) for r in N.similar_classes(df, "ord", "text").collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (9, 9, 0)]
    assert N.similar_pairs(df.limit(0), "ord", "text").count() == 0


def test_large_bucket_goes_through_the_join(spark, monkeypatch):
    monkeypatch.setattr(N, "IN_PLACE", 2)
    base = [f"c{j}" for j in range(120)]
    rows = [(i, " ".join([*base[:-1], f"tail{i}"])) for i in range(6)]
    df = spark.createDataFrame([(o, t, "", "") for o, t in rows], SCHEMA)
    assert {(r.ord_a, r.ord_b) for r in N.similar_pairs(df, "ord", "text").collect()} == brute(rows)


def test_no_pair_is_missed_near_the_bound(spark):
    rng, rows = random.Random(3), []
    for size in (30, 62, 66, 172, 242):
        for _ in range(25):
            base = [f"v{rng.randrange(5000)}" for _ in range(size)]
            rows.append((len(rows), " ".join(base)))
            for share in (0.1, 0.2, 0.3):
                w, at = list(base), rng.randrange(size // 2)
                w[at : at + int(share * size)] = [f"u{rng.randrange(5000)}" for _ in range(int(share * size))]
                rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([(o, t, "clash", "clash") for o, t in rows], SCHEMA)
    assert {(r.ord_a, r.ord_b) for r in N.similar_pairs(df, "ord", "text").collect()} == brute(rows)


def test_exact_way(spark):
    rows = corpus()
    df = spark.createDataFrame([(o, t, "clash", "clash") for o, t in rows], SCHEMA)
    got = [(r.ord_a, r.ord_b) for r in N.similar_pairs(df, "ord", "text", exact=True).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))
    banded = [(r.ord_a, r.ord_b) for r in N.similar_pairs(df, "ord", "text", exact=False).collect()]
    assert set(banded) <= brute(rows) and len(banded) == len(set(banded)) >= 0.99 * len(brute(rows))


def test_recall_by_size_and_similarity():
    """Share of generated pairs that meet in a band, at the border and beyond; the measure of the README."""
    import numpy as np

    rng = np.random.default_rng(2)
    for size in (23, 60, 100, 170, 250):
        for j in (0.5, 0.51, 0.56):
            common = int(np.ceil(2 * size * j / (1 + j)))
            sets = []
            for _ in range(400):
                x = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
                sets += [x[:size], np.r_[x[:common], x[size:]]]
            n = np.full(len(sets), size)
            who, key, _ = N._band_keys(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), n)
            keys = key.reshape(N.BANDS, -1)
            met = (keys[:, 0::2] == keys[:, 1::2]).any(0).mean()
            assert met >= 0.96, (size, j, met)


def test_copies_in_a_hot_group(spark):
    """A third of the rows are copies of one text, and many more share most of it."""
    base = [f"c{j}" for j in range(60)]
    rows = [(i, " ".join(base)) for i in range(40)] + [(100 + i, " ".join([*base[:-1], f"tail{i}"])) for i in range(40)] + [(200 + i, " ".join(f"x{i}y{j}" for j in range(40))) for i in range(40)]
    df = spark.createDataFrame([(o, t, "", "") for o, t in rows], SCHEMA)
    for exact in (True, False):
        assert {(r.ord_a, r.ord_b) for r in N.similar_pairs(df, "ord", "text", exact=exact).collect()} == brute(rows)
    classes = {r.ord: (r.class_id, r.n_links) for r in N.similar_classes(df, "ord", "text").collect()}
    assert {classes[o] for o in range(40)} == {(0, 40)} and {classes[100 + i] for i in range(40)} == {(0, 40)} and classes[205] == (205, 0)
