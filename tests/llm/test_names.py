import random
from itertools import combinations

from hirelake.llm import names as N
from hirelake.llm.components import connected_components

GROUPS = [
    ["Quillmere Staffing Partners", "QUILLMERE  STAFFING PARTNERS", "Quillmerre Staffing Partners", "Qullmere Staffing Partners Ltd", "Q.S.P.", "QSP", "Partners, Quillmere Staffing"],
    ["Grevabole Yewowkirk Pharma Inc", "The Grevabole Yewowkirk Pharma Company", "Grevaboleyewowkirk Pharma", "Grevabole & Yewowkirk Pharmaceuticals", "Grevab. Yewowkirk Pharma", "GREVABOLE YEOWWKIRK PHARMA", "Grevabole Yewowkirk - HR"],
    ["Katherine Fennabis Bakeries", "Fennabis, Katherine (Bakeries)", "Fennabis Kate Bakeries", "Kathy Fennabis"],
    ["Stone Bridge Law Chambers", "Stone Bridge Law Cham.", "STONE BRIDGE LAW CHAMBERS (HQ)"],
    ["Stone Bridge Lending Corporation", "Stone Bridge Lending Corp."],
    ["Bright Anvil Steel Fabricators", "Bright Anvil"],
    ["Deborah Yarbukory Plumbing", "Debbie Yarbukory Plumbing"],
    ["Deborah Astrukem Plumbing"],
]


def test_groups(spark):
    values = [v for g in GROUPS for v in g] + [None, "", " ", "nan", "Confidential", "n/a", "---", "x" * 5000]
    df = spark.createDataFrame([(v, "clash") for v in values + values], "company string, entity string")
    got = {r.name: r.entity for r in N.linked_names(df, "company").collect()}
    assert set(got) == {v for g in GROUPS for v in g} | {"x" * 5000}
    for g in GROUPS:
        assert len({got[v] for v in g}) == 1, g
    assert len({got[g[0]] for g in GROUPS}) == len(GROUPS)
    assert N.linked_names(df.limit(0), "company").count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row2 = [i]
        for j, y in enumerate(b, 1):
            row2.append(min(row[j] + 1, row2[-1] + 1, row[j - 1] + (x != y)))
        row = row2
    return row[-1]


def test_segments_against_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(70)})
    trade = ["", "foods", "glass"]
    s = spark.createDataFrame([(i, w, trade[i % 3]) for i, w in enumerate(words)], "id long, s string, trade string")
    got = {(r.id_a, r.id_b) for r in N.segment_pairs(s, s).collect()}
    want = set()
    for (i, a), (j, b) in combinations(enumerate(words), 2):
        d, ta, tb = lev(a, b), trade[i % 3], trade[j % 3]
        if ta and tb and ta != tb:
            continue
        if d <= 1 or d == 2 and (len(a) == len(b) and sorted(a) == sorted(b) or ta == tb != "" and (a[0], a[-1]) == (b[0], b[-1])):
            want |= {(i, j), (j, i)}
    assert got == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges[:120] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges[:120]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges[:120] if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_names(spark):
    groups = [["Smith Logistics", "Smiht Logistics", "Smithe Logistics"], ["Marlow Foods", "Marlowe Foods"], ["Smith Foods"], ["Htims Logistics"], ["Abe Glass"], ["Abel Glass"], ["Lima Foods"], ["Mila Foods"]]
    df = spark.createDataFrame([(v,) for g in groups for v in g], "company string")
    got = {r.name: r.entity for r in N.linked_names(df, "company").collect()}
    for g in groups:
        assert len({got[v] for v in g}) == 1, g
    assert len({got[g[0]] for g in groups}) == len(groups)


def test_trades_are_learned(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice(["ka", "lo", "mir", "ten", "dus", "vel", "or", "pin"]) for _ in range(4))
    rows = []
    for trade, short in (("shipwrights", "shpwrts"), ("apothecaries", "apoth")):
        for i in range(40):
            core = f"{part()} {part()}"
            rows += [(f"{core} {trade} Ltd",), (core + " " + (short if i % 3 else trade),)]
    df = spark.createDataFrame(rows, "company string")
    learned = N.learned_trades(df, "company")
    assert learned == {"shipwrights": "shpwrts", "apothecaries": "apoth"}
    assert N.with_learned({"wrights": "shipwrights wrts", "baker": ""}, learned) == {"wrights": "shipwrights wrts shpwrts", "baker": "", "apothecaries": "apoth"}
    # with the list emptied the spellings of a name still come together
    linked = {r.name: r.entity for r in N.linked_names(df, "company", trades=learned).collect()}
    assert len(set(linked.values())) == 80 and all(linked[rows[i][0]] == linked[rows[i + 1][0]] for i in range(0, len(rows), 2))
    assert N.learned_trades(df.limit(0), "company") == {}
