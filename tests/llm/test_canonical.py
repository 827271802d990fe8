import random

import pytest

from hirelake.llm import canonical as C

PLACES = [(1, "Mount Calloway", "US"), (2, "Ashgrove", "GB"), (3, "Ashgrove", "US"), (4, "Fürthenau", "DE"), (5, "North Fermoyle", "IE")]
ROLES = [(1, "Platform Engineer"), (2, "Database Administrator"), (3, "Head of Year"), (4, "Lecturer in Physics"), (5, "Bar Manager"), (6, "Staff Nurse")]


@pytest.mark.parametrize(
    "value, want",
    [
        ("Mt. Calloway; United States (on site)", 1), ("U.S.A. / Mount Cmlloway", 1), ("27 Ashgrove (US)", 3), ("Ashgrove, UK", 2), ("Ashgrove", -1), ("ASHGORVE 12, B, GB", 2),
        ("Furthenau", 4), ("Fuerthenau, Germany", 4), ("fürhtenau", 4), ("N. Fermoyle", 5), ("North Fermoyle, Spain", -1), ("Ireland", -1), ("Remote", -1), ("Dalvorno, Ireland", -1), ("x" * 50_000, -1), ("??", -1),
    ],
)
def test_places(value, want):
    assert C.place_matcher(PLACES)(value) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("Sr. Engineer, Platform", 1), ("platformengineer", 1), ("DB Admin / Team Lead", 2), ("Head of Year - Nights", 3), ("Osprey Team: Lecturer in Phsyics", 4), ("Part-time Bar Mgr (m/w/d)", 5),
        ("Bar Managers", 5), ("Staff-Nurse II", 6), ("Puppet Maker", -1), ("Senior", -1), ("asdf", -1),
    ],
)
def test_roles(value, want):
    assert C.role_matcher(ROLES)(value) == want


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force():
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    trie = C.Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for _ in range(300):
        q, k = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7))), rng.randint(0, 3)
        assert trie.search(q, k) == {i: osa(q, w) for i, w in enumerate(words) if osa(q, w) <= k}


def test_frame(spark):
    rows = spark.createDataFrame([(1, "Ashgrove, UK", "x"), (2, "Ashgrove, UK", "x"), (3, None, "x"), (4, " ", "x"), (5, "exact", "x"), (6, "nowhere", "x")], "id int, v string, ref string")
    exact = spark.createDataFrame([("exact",)], "value string")
    got = C.with_reference(rows, "v", exact, C.place_matcher, PLACES)
    assert sorted((r.id, r.ref_id) for r in got.collect()) == [(1, 2), (2, 2), (6, -1)]
    assert C.with_reference(rows.limit(0), "v", exact, C.place_matcher, PLACES).count() == 0
    with pytest.raises(ValueError):
        C.map_distinct(rows, "v", C.place_matcher, [None] * (C.MAX_ENTRIES + 1))


def test_pieces_give_the_same_answers(spark):
    values = ["Mt. Calloway; United States", "27 Ashgrove (US)", "Ashgrove", "ASHGORVE 12, B, GB", "fürhtenau", "Ashgrove, Fürthenau", "North Fermoyle, Spain", "nowhere", None, " "]
    rows = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id int, v string, rank string")
    one = {r.value: r.ref_id for r in C.mapped(rows, "v", C.place_candidates, [PLACES]).collect()}
    assert one == {v: C.place_matcher(PLACES)(v) for v in values if v and v.strip()}
    for n in (2, 5):
        assert {r.value: r.ref_id for r in C.mapped(rows, "v", C.place_candidates, [PLACES[i::n] for i in range(n)]).collect()} == one
    df = spark.createDataFrame(PLACES, "place_id int, town string, country_code string")
    assert sorted(x for p in C.in_pieces(df, 2) for x in p) == sorted(PLACES) and len(C.in_pieces(df, 2)) == 3


def test_all_entries_within_the_distance():
    find = C.place_candidates(PLACES, everything=True)
    assert {(i, d, fits) for i, d, _, fits in find("Ashgrove, UK")} == {(2, 0, True), (3, 0, False)}
    assert C.place_candidates([(1, "Ashgrove", "GB"), (2, "Ashgrave", "GB")], everything=True)("Ashgrove") in ([(1, 0, 1, True), (2, 1, 1001, True)], [(2, 1, 1001, True), (1, 0, 1, True)])


def test_own_words_as_parameters():
    assert C.role_matcher([(1, "Zoo Keeper")], short={"keeper": "kpr"}, levels={"boss"})("Boss Zoo Kpr") == 1
    assert C.place_matcher([(1, "Lake Ost", "XX"), (2, "Lake Ost", "YY")], short={"lake": "lk"}, countries={"XX": ["exland"]})("Lk Ost, Exland") == 1
