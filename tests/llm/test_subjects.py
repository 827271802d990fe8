import random

from hirelake.llm.subjects import subject_mixtures, subjects_of

SUBJECTS = ["law", "sport"]
WORDS = {"law": "court deed appeal judge statute clause tribunal counsel".split(), "sport": "match coach league goal referee training tennis gym".split()}
FILL = "the role will ask you to work with us in a small team on".split()


def docs(n=400, seed=3):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        own = rng.choice([["law"], ["sport"], ["law", "sport"], []])
        text = []
        for _ in range(30):
            text += [rng.choice(FILL) for _ in range(3)] + ([rng.choice(WORDS[rng.choice(own)])] if own else [])
        rows.append((i, " ".join(text), rng.choice(["en", "EN", "de", None]), "posting", "clash"))
        truth[i] = set(own)
    return rows, truth


SCHEMA = "doc_id long, text string, lang string, doc_kind string, mix string"


def test_held_out(spark):
    rows, truth = docs()
    rows += [(9001, None, "en", "posting", ""), (9002, "", "en", "mail", ""), (9003, " ?! ", None, None, "")]
    labels = [(i, f" {s.upper()} ") for i in range(80) for s in truth[i]] + [(1, None), (2, "unknown"), (99999, "law")]
    df = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels + labels[:5], "doc_id long, subject string")
    mix = subject_mixtures(df, lab, SUBJECTS)
    got = {}
    for r in subjects_of(mix, SUBJECTS).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    test = range(80, 400)
    assert sum(got.get(i, set()) == truth[i] for i in test) >= 0.9 * len(test)
    assert not set(got) & {9001, 9002, 9003}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame(docs(20)[0], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert subject_mixtures(df, none, SUBJECTS).count() == 0
    assert subject_mixtures(df.limit(0), none, SUBJECTS).count() == 0
