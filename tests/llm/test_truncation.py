from pyspark.sql import functions as F

from hirelake.llm import continuation as C
from hirelake.llm import textparts as T
from hirelake.llm.truncation import length_hazards, truncated

SCHEMA = "ord long, board string, text string, source string, cut string"
END = ["We look forward to hearing from you.", "Only shortlisted candidates will be contacted.", "No agencies, please."]


def rows():
    out, i = [], 0
    for k in range(60):
        base = f"Company {k} seeks a clerk for its office number {k}. You will file papers and keep the {'old ' * (k % 7)}records in order. "
        out.append((i, "a", base + END[k % 3]))
        i += 1
    whole = [
        "The team is small. We look forward to hearing from you",
        "The team is small. No agencies, please.\nShare this job  Report this job  Similar jobs near Town",
        "<div>The team is small. No agencies, please.</div><!-- end -->",
        "Ref follows. Reference: A6134",
        "Ask us. Contact: jobs@ember.example",
    ]
    cut = [
        "The team is small. We look forward to hea",
        "The team is small. Only shortlisted cand...",
        "The team is small. You will file pap [...]",
        "The team is small. Your predece�",
        "The team is small. You will file… (more)",
        "The team is small. You will file papers and See full ad >",
    ]
    none = [None, "", "  \n", "n/a", "-", "No description provided"]
    formula = [f"Office {k} opens in May. Curious? We would love to meet you…" for k in range(6)]
    labels = {}
    for texts, want in ((whole, False), (cut, True), (none, False), (formula, False)):
        for t in texts:
            labels[i] = want
            out.append((i, "a" if i % 2 else None, t))
            i += 1
    return out, labels


def test_endings(spark):
    data, labels = rows()
    df = spark.createDataFrame([(o, b, t, "clash", "clash") for o, b, t in data], SCHEMA)
    got = {r.ord: r.cut for r in truncated(df, "text", "board", ["ord"]).collect()}
    assert len(got) == len(data)
    assert {k: got[k] for k in labels} == labels
    assert not any(got[o] for o in range(60))


def test_length_limit_is_found_and_used(spark):
    lengths = [("a", n) for n in range(400, 1000) for _ in range(3)] + [("a", 600)] * 120 + [("b", n) for n in range(400, 1000)]
    h = length_hazards(spark.createDataFrame(lengths, "source string, n_chars int"))
    assert [(r.source, r.n_chars) for r in h.where("significant").collect()] == [("a", 600)]
    assert h.where("source = 'a' and n_chars = 600").first().at_risk == 3 * 400 + 120


def test_repeats_long_and_empty(spark):
    data = [(1, "a", "word " * 40_000 + "end.", "", ""), (2, "a", "word " * 40_000 + "en", "", ""), (3, "a", "x" * 200_000, "", ""), (3, "a", "x" * 200_000, "", "")]
    got = truncated(spark.createDataFrame(data, SCHEMA), "text", "board", ["ord"]).collect()
    assert sorted((r.ord, r.cut) for r in got)[0] == (1, False) and len(got) == 4
    assert truncated(spark.createDataFrame([], SCHEMA), "text", "board", ["ord"]).count() == 0


def test_finished_lines_of_their_own_stay(spark):
    import random

    rng = random.Random(5)
    syllables = ["ka", "lo", "mir", "ten", "dus", "vel", "or", "pin", "sha", "gul", "bre", "nox"]
    name = lambda: "".join(rng.choice(syllables) for _ in range(3)).title()
    duties = ["file the papers of the office", "keep the records in order", "answer letters from clients", "plan the work of the week", "welcome guests at the desk"]
    body = lambda: "You will " + ", ".join(rng.sample(duties, 3)) + f" and report to {name()}. The office of the team is small."
    closers = ["The desk is near gate {}", "Ask for {} at the office", "Papers go to {} in the week", "Signed, {}"]
    data = [(i, "a", body() + " You will answer letters from clients and keep the records in order.", "", "") for i in range(600)]
    whole = [(1000 + i, "a", body() + "\n" + closers[i % 4].format(name() + " " + name()), "", "") for i in range(200)]
    cuts = [(2000 + i, "a", body() + " You will " + ["answer letters from cli", "keep the rec", "answer letters fr", "keep the records in"][i % 4], "", "") for i in range(100)]
    got = {r.ord: r.cut for r in truncated(spark.createDataFrame(data + whole + cuts, SCHEMA), "text", "board", ["ord"]).collect()}
    assert sum(got[i] for i in range(1000, 1200)) <= 10
    assert sum(got[i] for i in range(2000, 2100)) >= 95
    assert not any(got[i] for i in range(600))


def test_evidence_equals_a_count_by_hand(spark):
    texts = ["we seek a clerk for kubernetes, and a clerk for kubernetes.", "we seek a clerk for kubernetes\n* a clerk for kuber", "no. clerk for kube", "a clerk for 40 days\nclerk for 工程师。", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string").select(C.flat(F.col("t")).alias("t"))
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(["seek a clerk for kuber", "his clerk for kubernetes", "a clerk for 4", "other clerk for 工程", "we seek a clerk now"])], "i int, last string")
    keys = C.asked_keys(asked.select("i", C.flat(F.col("last")).alias("last")), "last").cache()
    seen = {r.key: (r.n_on, r.n_end) for r in C.evidence(t, "t", keys.select(F.explode(F.array("key_two", "key_start")).alias("key"))).collect()}
    by = {r.i: r for r in keys.collect()}
    # the last word of an unfinished text says nothing; "kubernetes," goes on, "kubernetes." and a line of its own end
    assert [seen.get(by[i].key_two) for i in range(4)] == [(3, 0), (1, 2), None, (1, 0)]
    assert seen[by[4].key_start] == (2, 0)


def test_clutter(spark):
    df = spark.createDataFrame([("We use cookies. Accept all",), ("plain text <br> more",), ("a < b and c",), (None,)], "t string")
    assert [r[0] for r in df.select(T.has_clutter(F.col("t"))).collect()] == [True, True, False, False]
