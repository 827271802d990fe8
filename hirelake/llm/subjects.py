"""Subject areas of documents by a seeded factorisation of the document-term matrix.

Terms are words and pairs of neighbouring words (for Han text pairs of characters), hashed. Documents
are dealt to languages by the terms of the language labels, since labels can be wrong; languages that are too
seldom for a model of their own share one. For each
language the matrix of counts X is factored as W H with non-negative alternating multiplicative
updates (Kullback-Leibler form, which keeps row sums, so a row of W says how many of a document's
terms each component explains). Each subject has an anchored component, seeded by what labelled
documents hold in excess of their kind; each kind of document has a background component for
its stock phrases, and small kinds share one. Labelled documents may use only their own subjects. The rows of W over the
subject components are the subject mixture.

Documents travel in packed blocks of numbers, made once from the texts. W stays in executors and is remade from H; sums for H
are combined there, and only H comes to the driver. Its size is bounded by languages x components x ``DIMENSION``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.plan import fenced
from hirelake.llm.bytewords import slices, word_hashes
from hirelake.session import cut
from hirelake.sources.tables import spread, table

DIMENSION = 1 << 18
#: A term counts from so many documents of its language.
LEAST_DOCS = 5
#: Languages with a model of their own, at most and from how many documents; the others share one. Likewise kinds of a language.
OWN_LANGUAGES, LANGUAGE_DOCS = 8, 30
OWN_KINDS, KIND_DOCS = 8, 20
#: Labelled documents that seed the components; beyond it a fixed sample by the hash of their id.
MAX_LABELLED = 20_000
ROUNDS, INNER, LAST_INNER, SETTLED = 4, 10, 25, 0.01
LABEL_WEIGHT, SEED_WEIGHT, KIND_DAMPING, EXCESS = 5.0, 0.3, 0.2, 1.5
#: A subject counts from this share of the subject terms; a document has subjects from this share of its terms.
LEAST_MIX, LEAST_MASS = 0.22, 0.03
#: Documents of like length that are factored side by side.
ABREAST = 32


def _mixed(x):
    import numpy as np

    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(33)


def _matrix(column, dimension: int = DIMENSION):
    """(terms of each text, term numbers, counts) of flat texts; terms are in order within a text."""
    import numpy as np

    sizes, idx, cnt = np.zeros(len(column), np.int32), [], []
    for first, n, b in slices(column):
        h, row, han = word_hashes(b)
        pair = row[1:] == row[:-1]
        both = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pair]
        term = np.r_[_mixed(h[~han]), both] % np.uint64(dimension)
        code, count = np.unique(np.r_[row[~han], row[1:][pair]].astype(np.int64) * dimension + term.astype(np.int64), return_counts=True)
        sizes[first : first + n] = np.bincount(code // dimension, minlength=n)
        idx.append((code % dimension).astype(np.int32))
        cnt.append(np.minimum(count, 65535).astype(np.uint16))
    none = np.zeros(0, np.int32)
    return sizes, np.concatenate([none, *idx]).astype(np.int32), np.concatenate([none, *cnt]).astype(np.uint16)


_BLOCK = "sizes binary, idx binary, cnt binary"


def _blocks(docs: DataFrame, key_type: str) -> DataFrame:
    """Packed blocks of (key, flat, label_lang, kind): keys, label_lang and kind as lists, the matrix as bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, idx, cnt = _matrix(batch.column("flat"))
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("key", "label_lang", "kind")]
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, idx, cnt))], names=["keys", "langs", "kinds", "sizes", "idx", "cnt"])

    return docs.select("key", "flat", "label_lang", "kind").mapInArrow(run, f"keys array<{key_type}>, langs array<string>, kinds array<string>, {_BLOCK}")


def _unpacked(batch, i: int):
    import numpy as np

    return tuple(np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("sizes", np.int32), ("idx", np.int32), ("cnt", np.uint16)))


def _term_sums(blocks: DataFrame, add, width: int, n_lang: int):
    """(language, term, ``width`` sums) of all blocks, combined in each task and then in Spark; a pandas frame of at most
    languages x ``DIMENSION`` rows. ``add`` gets the sums of a task, (languages, terms, width), and a block."""
    cols = [f"s{k}" for k in range(width)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict[int, object] = {}

        def of(lang: int, size: int):
            if lang not in sums:
                sums[lang] = np.zeros((size, width), np.float64)
            return sums[lang]

        for batch in batches:
            for i in range(batch.num_rows):
                add(of, batch, i)
        for lang, s in sums.items():
            used = np.flatnonzero(s.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), lang, np.int32)), pa.array(used.astype(np.int32)), *(pa.array(s[used, k].astype(np.float32)) for k in range(width))], names=["lang", "term", *cols])

    # as many tasks as cores at most: each hands on its sums once
    few = blocks.coalesce(max(8, blocks.sparkSession.sparkContext.defaultParallelism))
    partial = few.mapInArrow(run, "lang int, term int, " + ", ".join(f"{c} float" for c in cols))
    return partial.groupBy("lang", "term").agg(*(F.sum(c).cast("float").alias(c) for c in cols)).toPandas()


class _Model:
    """Components of each language over its own terms: H[language] has the subjects first, then the kinds; place[language] numbers its terms."""

    def __init__(self, n_subjects: int, place, H) -> None:
        import numpy as np

        self.n_subjects, self.place = n_subjects, place
        # transposed, with a row of zeros for the padding of short documents
        self.H = [np.ascontiguousarray(np.vstack([h.T, np.zeros((1, h.shape[0]), np.float32)]).astype(np.float32)) for h in H]


def _padded(model: _Model, lang: int, sizes, idx, cnt) -> Iterator:
    """(numbers of documents, terms, counts) of documents of like length, as matrices; only kept terms, and documents with one."""
    import numpy as np

    place = model.place[lang]
    t = place[idx]
    kept = t >= 0
    doc = np.repeat(np.arange(len(sizes)), sizes)[kept]
    t, c = t[kept], cnt[kept].astype(np.float32)
    n = np.bincount(doc, minlength=len(sizes))
    start = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    none = len(model.H[lang]) - 1
    at = 0
    while at < len(order):
        # a matrix stays in the cache: about as many numbers as its longest document or 16,000 need
        stop = min(at + ABREAST, len(order))
        while stop - at > 1 and (stop - at) * n[order[stop - 1]] > 16_000:
            stop = at + (stop - at) // 2
        d = order[at:stop]
        width = n[d[-1]]
        inside = np.arange(width) < n[d][:, None]
        source = np.minimum(start[d][:, None] + np.arange(width), len(t) - 1)
        yield d, np.where(inside, t[source], none), np.where(inside, c[source], np.float32(0))
        at = stop


def _em(Hn, cnt, mask, inner: int, settled: float = 0.0):
    """W of documents side by side: Hn (documents, terms, components), by ``inner`` multiplicative updates or until W is settled."""
    import numpy as np

    total = cnt.sum(1)
    W = (mask * (total / np.maximum(mask.sum(1), 1))[:, None]).astype(np.float32)
    for step in range(inner):
        q = cnt / np.maximum(np.matmul(Hn, W[:, :, None])[:, :, 0], 1e-12)
        fresh = W * np.matmul(q[:, None, :], Hn)[:, 0, :]
        moved = np.abs(fresh - W).sum(1) if settled and step % 5 == 4 else None
        W = fresh
        if moved is not None and (moved <= settled * total).all():
            break
    return W


def _gather(s, terms: list, parts: list) -> None:
    """Adds the parts of all terms to their rows of ``s``, and empties the lists."""
    import numpy as np

    if terms:
        t, p = np.concatenate(terms), np.concatenate(parts)
        for k in range(p.shape[1]):
            s[:, k] += np.bincount(t, p[:, k], len(s))
        terms.clear()
        parts.clear()


def _round(blocks: DataFrame, model: _Model, labels: dict) -> list:
    """One alternating update of H: for each language the sums over the components from all documents."""
    import numpy as np

    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast((model, labels))
    width = max(h.shape[1] for h in model.H)

    def add(of, batch, i) -> None:
        m, known = shared.value
        lang, K = batch.column("lang")[i].as_py(), m.n_subjects
        H = m.H[lang]
        s = of(lang, len(H))
        keys = batch.column("keys")[i].as_py()
        terms, parts, held = [], [], 0
        for d, t, c in _padded(m, lang, *_unpacked(batch, i)):
            mask, weight = np.ones((len(d), H.shape[1]), np.float32), np.ones(len(d), np.float32)
            for r, j in enumerate(d):
                if own := known.get(keys[j]):
                    mask[r, :K] = 0
                    mask[r, own] = 1
                    weight[r] = LABEL_WEIGHT
            Hn = H[t]
            W = _em(Hn, c, mask, INNER)
            q = weight[:, None] * c / np.maximum(np.matmul(Hn, W[:, :, None])[:, :, 0], 1e-12)
            real = c.reshape(-1) > 0
            terms.append(t.reshape(-1)[real])
            parts.append((Hn * W[:, None, :] * q[:, :, None]).reshape(-1, H.shape[1])[real])
            held += len(terms[-1])
            if held > 400_000:
                _gather(s, terms, parts)
                held = 0
        _gather(s, terms, parts)

    total = _term_sums(blocks, add, width, len(model.H))
    shared.destroy()
    out = []
    for lang, h in enumerate(model.H):
        mine = total[total["lang"] == lang]
        s = np.zeros((len(h), h.shape[1]), np.float32)
        s[mine["term"].to_numpy()] = mine[[f"s{k}" for k in range(h.shape[1])]].to_numpy()
        out.append(s[:-1].T)
    return out


def _normed(h):
    import numpy as np

    h = h + 1e-7
    return (h / h.sum(1)[:, None]).astype(np.float32)


def subject_mixtures(docs: DataFrame, labels: DataFrame, subjects: list[str], key: str = "doc_id", text: str = "text", language: str = "lang", kind: str = "doc_kind", seed_share: float = 1.0) -> DataFrame:
    """(key, mix ARRAY<DOUBLE> over ``subjects``, mass DOUBLE) for each document with a word.

    ``mix`` sums to 1 (all 0 if nothing of the document is explained by subjects, as where it has no term that others share);
    ``mass`` is the share of its
    terms that subjects explain. NULL, empty and blank texts, and texts without a letter or digit, have no
    row. ``labels`` (key, subject): subjects are compared without letter case and outer spaces; NULL and unknown ones,
    repeated rows and labels of missing documents are ignored. Without any usable label, or for an empty
    table, there are no rows. ``seed_share`` keeps a share of the labelled documents as seeds, by the hash of their key,
    so that the rest can test the result.
    """
    import numpy as np

    spark = docs.sparkSession
    sc = spark.sparkContext
    number = {s.strip().lower(): i for i, s in enumerate(subjects)}
    key_type = docs.schema[key].dataType.simpleString()
    empty = spark.createDataFrame([], f"{key} {key_type}, mix array<double>, mass double")
    said = F.lower(F.substring(F.btrim(F.col(language)), 1, 2))
    base = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("__text"), F.when(~said.isin("", "un"), said).alias("label_lang"), F.coalesce(F.col(kind), F.lit("")).alias("kind"))
    flat = fenced(F.btrim(F.regexp_replace(F.lower("__text"), r"[^\p{L}\p{N}]+", " ")))
    blocks = cut(_blocks(spread(base).withColumn("flat", flat).where(F.col("flat") != "").select("key", "flat", "label_lang", "kind"), key_type))

    # the labelled sample: its keys and subjects are bounded, and go to the workers
    code = F.create_map(*(F.lit(x) for kv in number.items() for x in kv))
    clean = labels.select(F.col(key).alias("key"), F.lower(F.btrim("subject")).alias("s")).where(F.col("s").isin(list(number)) & F.col("key").isNotNull())
    per_doc = clean.groupBy("key").agg(F.array_sort(F.collect_set(F.element_at(code, F.col("s")))).alias("labels"))
    if seed_share < 1:
        per_doc = per_doc.where(F.pmod(F.xxhash64(F.lit("seed"), "key"), F.lit(1000)) < int(1000 * seed_share))
    known = {r.key: list(r.labels) for r in per_doc.orderBy(F.xxhash64("key")).limit(MAX_LABELLED).collect()}
    if not known:
        return empty

    by_lang = blocks.select(F.explode("langs").alias("l")).where("l is not null").groupBy("l").count().orderBy(F.desc("count"), "l").limit(OWN_LANGUAGES + 1).collect()
    languages = [r.l for r in by_lang[:OWN_LANGUAGES] if r["count"] >= LANGUAGE_DOCS] or [r.l for r in by_lang[:1]]
    # the model that all other languages share; without labels of a language there is only this one
    languages += ["*"] if len(by_lang) > len(languages) or not languages else []
    number_of = {x: i for i, x in enumerate(languages)}
    shared_lang = number_of.get("*")

    def add_language(of, batch, i) -> None:
        sizes, idx, cnt = _unpacked(batch, i)
        lang = np.array([-1 if x is None else number_of.get(x, shared_lang) for x in batch.column("langs")[i].as_py()])
        if len(languages) == 1:
            lang[:] = 0
        per = np.repeat(lang, sizes)
        for x in np.unique(lang[lang >= 0]):
            of(int(x), DIMENSION)[:, 0] += np.bincount(idx[per == x], cnt[per == x], DIMENSION)

    counts = _term_sums(blocks, add_language, 1, len(languages))
    P = np.full((len(languages), DIMENSION), 0.1, np.float32)
    P[counts["lang"].to_numpy(), counts["term"].to_numpy()] += counts["s0"].to_numpy()
    tables = sc.broadcast(np.log(P / P.sum(1)[:, None]).astype(np.float32))
    del counts, P

    def deal(batches: Iterator) -> Iterator:
        """Blocks of one language each, the likeliest for each document."""
        import pyarrow as pa

        logp = tables.value
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, idx, cnt = _unpacked(batch, i)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                likely = np.stack([np.bincount(doc, logp[x][idx] * cnt, len(sizes)) for x in range(len(languages))])
                best = likely.argmax(0)
                keys, kinds = batch.column("keys")[i].values, batch.column("kinds")[i].values
                for x in np.unique(best):
                    mine = best == x
                    at, terms = pa.array(np.flatnonzero(mine)), mine[doc]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), c.take(at)) for c in (keys, kinds)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int32()), *lists, *(pa.array([v.tobytes()], pa.binary()) for v in (sizes[mine], idx[terms], cnt[terms]))], names=["lang", "keys", "kinds", "sizes", "idx", "cnt"])

    dealt = cut(blocks.mapInArrow(deal, f"lang int, keys array<{key_type}>, kinds array<string>, {_BLOCK}"))
    by_kind = dealt.select("lang", F.explode("kinds").alias("kind")).groupBy("lang", "kind").count().orderBy(F.desc("count"), "lang", "kind").limit(64 * OWN_KINDS).collect()
    kinds = [[r.kind for r in by_kind if r.lang == x and r["count"] >= KIND_DOCS][:OWN_KINDS] for x in range(len(languages))]
    slot_of = [{k: j for j, k in enumerate(ks)} for ks in kinds]
    slots = [len(ks) + 1 for ks in kinds]  # the last for all other kinds
    K = len(subjects)
    seeds = sc.broadcast(known)
    wide = 1 + max(slots)

    def add_kinds(of, batch, i) -> None:
        """Documents of each term, and its occurrences in each kind."""
        lang = batch.column("lang")[i].as_py()
        sizes, idx, cnt = _unpacked(batch, i)
        slot = np.array([slot_of[lang].get(k, slots[lang] - 1) for k in batch.column("kinds")[i].as_py()])
        s, per = of(lang, DIMENSION), np.repeat(slot, sizes)
        s[:, 0] += np.bincount(idx, minlength=DIMENSION)
        for x in np.unique(slot):
            s[:, 1 + x] += np.bincount(idx[per == x], cnt[per == x], DIMENSION)

    means = _term_sums(dealt, add_kinds, wide, len(languages))
    place, backs = [], []
    for x in range(len(languages)):
        m = means[(means["lang"] == x) & (means["s0"] >= LEAST_DOCS)].sort_values("term")
        if not len(m):  # a few documents only: all their terms count
            m = means[means["lang"] == x].sort_values("term")
        p = np.full(DIMENSION, -1, np.int32)
        p[m["term"].to_numpy()] = np.arange(len(m))
        place.append(p)
        back = m[[f"s{1 + j}" for j in range(slots[x])]].to_numpy(np.float64).T + 1e-4
        backs.append(back / np.maximum(back.sum(1)[:, None], 1e-12))
    del means
    frame = sc.broadcast((place, backs))

    def add_excess(of, batch, i) -> None:
        """What labelled documents hold in excess of their kind, for each of their subjects."""
        lang = batch.column("lang")[i].as_py()
        place, backs = frame.value
        sizes, idx, cnt = _unpacked(batch, i)
        start = np.cumsum(sizes) - sizes
        kinds_here = None
        for j, k in enumerate(batch.column("keys")[i].as_py()):
            own = seeds.value.get(k)
            if not own:
                continue
            kinds_here = kinds_here or batch.column("kinds")[i].as_py()
            t, c = place[lang][idx[start[j] : start[j] + sizes[j]]], cnt[start[j] : start[j] + sizes[j]].astype(np.float64)
            c, t = c[t >= 0], t[t >= 0]
            expected = c.sum() * backs[lang][slot_of[lang].get(kinds_here[j], slots[lang] - 1)]
            s = of(lang, backs[lang].shape[1])
            for subject in own:
                s[:, subject] -= EXCESS * expected / len(own)
                s[t, subject] += c / len(own)

    excess = _term_sums(dealt, add_excess, K, len(languages))
    H = []
    for x in range(len(languages)):
        e = np.zeros((K, backs[x].shape[1]))
        mine = excess[excess["lang"] == x]
        e[:, mine["term"].to_numpy()] = np.maximum(mine[[f"s{k}" for k in range(K)]].to_numpy().T, 0)
        back = backs[x].copy()
        back[:, (e > 1e-6).any(0)] *= KIND_DAMPING
        H.append(_normed(np.vstack([e, back])))
    seeded = [h[:K].copy() for h in H]
    model = _Model(K, place, H)
    for _ in range(ROUNDS):
        fresh = []
        for x, s in enumerate(_round(dealt, model, known)):
            s[:K] += SEED_WEIGHT * seeded[x] * s[:K].sum(1)[:, None]
            fresh.append(_normed(s))
        model = _Model(K, place, fresh)
    shared = sc.broadcast(model)

    def mixtures(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column("lang")[i].as_py()
                sizes, idx, cnt = _unpacked(batch, i)
                mix, mass = np.zeros((len(sizes), K)), np.zeros(len(sizes))
                for d, t, c in _padded(m, lang, sizes, idx, cnt):
                    W = _em(m.H[lang][t], c, np.ones((len(d), m.H[lang].shape[1]), np.float32), LAST_INNER, SETTLED)
                    own = W[:, :K].astype(np.float64)
                    sub = own.sum(1)
                    mix[d] = own / np.maximum(sub, 1e-12)[:, None]
                    mass[d] = sub / np.maximum(W.sum(1), 1e-12)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, mix.size + 1, K, dtype=np.int32)), pa.array(mix.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, rows, pa.array(mass)], names=[key, "mix", "mass"])

    return dealt.mapInArrow(mixtures, f"{key} {key_type}, mix array<double>, mass double")


def subjects_of(mixtures: DataFrame, subjects: list[str], key: str = "doc_id", least_mix: float = LEAST_MIX, least_mass: float = LEAST_MASS) -> DataFrame:
    """(key, subject, share) of each subject with at least ``least_mix`` of a document's subject terms."""
    names = F.array(*(F.lit(s) for s in subjects))
    long = mixtures.where(F.col("mass") >= least_mass).select(key, F.posexplode("mix").alias("i", "share")).where(F.col("share") >= least_mix)
    return long.select(key, F.get(names, F.col("i")).alias("subject"), F.round("share", 4).alias("share"))


def _mixtures(spark, sf_dir: str, seed_share: float = 1.0) -> tuple[DataFrame, list[str]]:
    subjects = [r.subject for r in table(spark, sf_dir, "subject_list").orderBy("subject").collect()]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "doc_kind")
    return subject_mixtures(docs, table(spark, sf_dir, "doc_labels"), subjects, seed_share=seed_share), subjects


def p9_found(spark, sf_dir: str) -> DataFrame:
    """(doc_id, subject): the subject areas of each document."""
    mix, subjects = _mixtures(spark, sf_dir)
    return subjects_of(mix, subjects).select("doc_id", "subject")


def p9_composition(spark, sf_dir: str) -> DataFrame:
    """(subject, n_docs, weight, share): the make-up of the corpus; weights add the subject mixtures of documents."""
    mix, subjects = _mixtures(spark, sf_dir)
    long = subjects_of(mix, subjects, least_mix=0.0)
    per = long.groupBy("subject").agg(F.count_if(F.col("share") >= LEAST_MIX).alias("n_docs"), F.round(F.sum("share"), 2).alias("weight"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("weight").alias("__all")))).select("subject", "n_docs", "weight", F.round(F.col("weight") / F.col("__all"), 4).alias("share"))  # one row
