"""Near-duplicate texts by banded minima of shingles, parity sketches and an exact check.

A text is the set of its word shingles. The least hash of a set under one of many hash functions is equal for
two sets with the probability of their similarity; ``ROWS`` such minima make the key of a band, and texts with an
equal band are candidates. With 128 bands of five minima a pair is met with probability 0.983 at a similarity of 0.5, 0.999 at
0.55 and nearly 1 beyond, whatever the sizes. Candidates are pruned by a parity sketch (each
shingle flips one bit) whose Hamming distance is a lower bound of the number of differing shingles, and the rest are
verified exactly on the shingles. ``exact=True``, the default of the functions, takes prefixes instead of bands, which no pair can miss: two sets of
n and m shingles with a similarity of at least t share c >= t * max(n, m) of them, so the first n - c + 1 of the one
and m - c + 1 of the other, in any order common to all texts, have one in common. It makes as many candidates
as texts share seldom shingles, which grows with the square of a collection written from stock phrases.

Keys travel packed: a text's keys go to parts by their hash, and a part gets arrays of 8 bytes for a key,
a short key and a short id, sorted. In a part equal keys stand side by side and give their pairs; a key of very many
texts goes on in blocks, of which each two give their pairs in a task of their own. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.plan import fenced
from hirelake.llm.bytewords import slices, word_hashes
from hirelake.llm.components import connected_components
from hirelake.session import cut
from hirelake.sources.tables import table

SHINGLE = 3
SIMILARITY = 0.5
LEAST_WORDS = 25
BIT_WORDS = 8  # 512 bits
#: Minima of a band, and bands.
ROWS, BANDS = 5, 128
#: Groups of texts with one key up to this size give their pairs in place; larger ones in blocks of so many texts.
IN_PLACE = 1024
#: Keys in a part, about: 8 bytes each.
PART_KEYS = 250_000
#: A packed key: so many bits of the key above so many of the id.
KEY_BITS, ID_BITS = 24, 40
#: Ids of candidates, of 16 bytes, are broadcast up to this count, which is taken first; beyond it they are shuffled.
MAX_BROADCAST_IDS = 500_000


#: Slots of the counts that order the shingles, and about how many texts are counted.
SLOT_BITS = 19
COUNTED_TEXTS = 20_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case, with single spaces between them."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _shingles(column, k: int, bits: int = 20):
    """(number of the text, hash) of the different runs of ``k`` words of each text of words, in order of the text.

    A text and a hash of 64 - ``bits`` bits are sorted as one number, so ``bits`` must hold the numbers of the texts of a slice.
    """
    import numpy as np

    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low, high = np.uint64(bits), np.uint64(64 - bits)
    for first, n, b in slices(column):
        if n >> bits:
            raise ValueError(f"{n} texts in a slice")
        words, row, _ = word_hashes(b, split_han=False)
        m = len(words) - k + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = (h ^ words[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = row[:m] == row[k - 1 :]
        both = np.sort(row[:m][whole].astype(np.uint64) << high | h[whole] >> low)
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        docs.append((both >> high).astype(np.int64) + first)
        hashes.append(_mixed(both << low))
    return np.concatenate(docs), np.concatenate(hashes)


def _slots(h):
    import numpy as np

    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _count(batches: Iterator, k: int) -> Iterator:
    """(slot, n): in how many texts of a task shingles of a slot stand."""
    import numpy as np
    import pyarrow as pa

    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(_slots(_shingles(batch.column("words"), k)[1]), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def _mixed(x):
    import numpy as np

    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(29)


def _band_keys(doc, h, n):
    """(number of the text, key, None) of the bands of each text; all texts have a shingle."""
    import numpy as np

    rng = np.random.default_rng(20250701)
    factors = rng.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    keys = np.empty((BANDS, len(n)), np.uint64)
    text = 0
    bounds = np.r_[0, np.cumsum(n)]
    while text < len(n):  # pieces that stay in the cache
        stop = max(text + 1, int(np.searchsorted(bounds, bounds[text] + (1 << 17), "right")) - 1)
        part = (h[bounds[text] : bounds[stop]] >> np.uint64(16)).astype(np.uint32)
        starts = bounds[text:stop] - bounds[text]
        for b in range(BANDS):
            key = np.full(stop - text, b + 1, np.uint64)
            for r in range(ROWS):
                x = part * factors[b * ROWS + r]
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, starts))
            keys[b, text:stop] = key
        text = stop
    return np.tile(np.arange(len(n)), BANDS), keys.reshape(-1), None


def _prefix_keys(doc, h, n, similarity: float, counts):
    """(number of the text, key, sizes) of the prefix of each text in the order of ``counts``; sizes hold how many shingles the text has, and
    how many from this one on."""
    import numpy as np

    prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    order = np.lexsort((h, counts[_slots(h)], doc))
    at = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]  # doc is in order before and after
    keep = at < prefix[doc]
    d, rest = doc[keep], (n[doc] - at)[keep]
    few = lambda x: np.minimum(x, 65535).astype(np.uint32)  # noqa: E731 - less than there are only lets more pairs pass
    return d, _mixed(h[order][keep]), few(n[d]) << np.uint32(16) | few(rest)


def _enough(a, b, similarity: float):
    """At their first shingle in common the rest of both texts must hold all that they have to share."""
    import numpy as np

    n = (a >> np.uint32(16)).astype(np.int64) + (b >> np.uint32(16))
    return np.minimum(a & np.uint32(65535), b & np.uint32(65535)) * (1 + similarity) >= n * similarity - 1e-6


SKETCHED = "part int, ord bigint, id bigint, n int, bits array<bigint>, keys binary, sizes binary"
FOUND = "ord bigint, id bigint, n int, bits array<bigint>, a bigint, b bigint, heavy bigint, members binary"


def _sketch(batches: Iterator, k: int, parts: int, keys_of) -> Iterator:
    """``SKETCHED`` rows of (ord, id, words): one for each text with its bit sketch, and one for each part with packed keys."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy().view(np.uint64)
        doc, h = _shingles(batch.column("words"), k)
        n = np.bincount(doc, minlength=len(ids))
        bits = np.zeros((len(ids), BIT_WORDS), np.uint64)
        np.bitwise_xor.at(bits, (doc, (h & np.uint64(BIT_WORDS - 1)).astype(np.int64)), np.uint64(1) << (h >> np.uint64(3) & np.uint64(63)))
        bit_lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * BIT_WORDS, BIT_WORDS, dtype=np.int32)), pa.array(bits.reshape(-1).view(np.int64)))
        none = lambda kind, m=len(ids): pa.nulls(m, kind)
        yield pa.RecordBatch.from_arrays([pa.array((_mixed(ids) % np.uint64(parts)).astype(np.int32)), batch.column("ord"), batch.column("id"), pa.array(n.astype(np.int32)), bit_lists, none(pa.binary()), none(pa.binary())], names=["part", "ord", "id", "n", "bits", "keys", "sizes"])
        _, first = np.unique(ids, return_index=True)  # copies in a batch send their keys once
        sends = np.zeros(len(ids), bool)
        sends[first] = True
        mine = sends[doc]
        doc, h = (np.cumsum(sends) - 1)[doc[mine]], h[mine]
        who, key, sizes = keys_of(doc, h, n[sends])
        part = ((key >> np.uint64(KEY_BITS)) % np.uint64(parts)).astype(np.int32)
        packed = (key & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(ID_BITS) | (ids[sends] & np.uint64((1 << ID_BITS) - 1))[who]
        part = part.astype(np.uint16 if parts <= 1 << 16 else np.int32)  # small numbers are sorted by counting
        order = np.argsort(part, kind="stable")
        part, packed = part[order], packed[order]
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        pieces = np.split(packed, start[1:]) if len(part) else []
        if sizes is None:
            blobs, more = pa.array([_folded(np.sort(x)) for x in pieces], pa.binary()), none(pa.binary(), len(pieces))
        else:
            turns = [np.argsort(x) for x in pieces]
            blobs = pa.array([_folded(x[t]) for x, t in zip(pieces, turns, strict=True)], pa.binary())
            more = pa.array([x[t].tobytes() for x, t in zip(np.split(sizes[order], start[1:]) if len(part) else [], turns, strict=True)], pa.binary())
        m = len(start)
        yield pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int32)), none(pa.int64(), m), none(pa.int64(), m), none(pa.int32(), m), none(bit_lists.type, m), blobs, more], names=["part", "ord", "id", "n", "bits", "keys", "sizes"])


def _folded(x) -> bytes:
    """Sorted numbers as the bytes of their steps, plane by plane: the upper planes are zeros and compress."""
    import numpy as np

    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unfolded(data: bytes):
    import numpy as np

    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _pairs(of, run, longest: int) -> Iterator:
    """All pairs within runs of equal ``run``, about a million at a time: (first, second), by their distance in the sorted arrays."""
    import numpy as np

    at, out, held = np.arange(len(run) - 1), [], 0
    for d in range(1, longest):
        at = at[at + d < len(run)]
        at = at[run[at + d] == run[at]]
        for i in range(0, len(at), 1 << 20):
            some = at[i : i + (1 << 20)]
            out.append((of[some], of[some + d]))
            held += len(some)
            if held >= 1 << 20:
                yield tuple(np.concatenate([x[i] for x in out]) for i in (0, 1))
                out, held = [], 0
        if not len(at):
            break
    if out:
        yield tuple(np.concatenate([x[i] for x in out]) for i in (0, 1))


def _meet(batches: Iterator, in_place: int, similarity: float) -> Iterator:
    """``FOUND`` rows of a partition of ``SKETCHED`` ones: the texts as they are, pairs of short ids, and members of heavy keys in blocks."""
    import numpy as np
    import pyarrow as pa

    names = ["ord", "id", "n", "bits", "a", "b", "heavy", "members"]
    blobs: dict[int, list] = {}
    for batch in batches:
        keys = batch.column("keys")
        texts = batch.filter(keys.is_null())
        if texts.num_rows:
            m = texts.num_rows
            yield pa.RecordBatch.from_arrays([*(texts.column(c) for c in names[:4]), *(pa.nulls(m, t) for t in (pa.int64(),) * 3), pa.nulls(m, pa.binary())], names=names)
        kept = batch.filter(keys.is_valid())
        for part, data, more in zip(kept.column("part").to_pylist(), kept.column("keys"), kept.column("sizes"), strict=True):
            blobs.setdefault(part, []).append((_unfolded(data.as_py()), None if more.as_py() is None else np.frombuffer(more.as_py(), np.uint32)))
    bit_type = pa.list_(pa.int64())
    seen: list = []  # pairs of this task, each once as far as memory allows

    def once(least: int):
        if sum(len(x) for x, _ in seen) < least:
            return
        a, b = (np.concatenate([x[i] for x in seen]) for i in (0, 1))
        seen.clear()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        for i in range(0, int(new.sum()), 1 << 20):
            x, y = a[new][i : i + (1 << 20)], b[new][i : i + (1 << 20)]
            m = len(x)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), bit_type)), pa.array(x), pa.array(y), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names=names)

    for part, arrays in blobs.items():
        sizes = None
        if arrays[0][1] is None:
            packed = np.unique(np.concatenate([x for x, _ in arrays]))  # copies meet here
        else:
            packed, at = np.unique(np.concatenate([x for x, _ in arrays]), return_index=True)
            sizes = np.concatenate([x for _, x in arrays])[at]
        key, ids = packed >> np.uint64(ID_BITS), (packed & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        light = np.repeat((size > 1) & (size <= in_place), size)
        places = np.flatnonzero(light)
        for x, y in _pairs(places, key[light], in_place):
            if sizes is not None:
                fits = _enough(sizes[x], sizes[y], similarity)
                x, y = x[fits], y[fits]
            seen.append((ids[x], ids[y]))
            yield from once(1 << 22)
        for s, m in zip(start[size > in_place], size[size > in_place], strict=True):
            blocks = [ids[s + i : s + min(m, i + in_place)].tobytes() for i in range(0, m, in_place)]
            w = len(blocks)
            heavy = np.full(w, int(part) << KEY_BITS | int(key[s]), np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(w, t) for t in (pa.int64(), pa.int64(), pa.int32(), bit_type, pa.int64(), pa.int64())), pa.array(heavy), pa.array(blocks, pa.binary())], names=names)
    yield from once(1)


def _across(batches: Iterator) -> Iterator:
    """(a, b) of two blocks of members of one key: all pairs between them, or within a block beside itself."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            a, b = (np.frombuffer(v.as_py(), np.int64) for v in (x, y))
            if x == y:
                i, j = np.triu_indices(len(a), 1)
            else:
                i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
            yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j])], names=["a", "b"])


def _compared(batches: Iterator, k: int, together: int = 2000) -> Iterator:
    """(id_a, id_b, jaccard) of (id_a, id_b, w_a, w_b), exactly."""
    import numpy as np
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, together):
            batch = whole.slice(at, together)
            # by 52 bits of a hash; each shingle stands once in each of the two sets
            (doc_a, h_a), (doc_b, h_b) = (_shingles(batch.column(c), k, 12) for c in ("w_a", "w_b"))
            both = np.sort(np.r_[doc_a, doc_b].astype(np.uint64) << np.uint64(52) | np.r_[h_a, h_b] >> np.uint64(12))
            doc = (both >> np.uint64(52)).astype(np.int64)
            common = np.bincount(doc[1:][both[1:] == both[:-1]], minlength=batch.num_rows)
            union = np.bincount(doc, minlength=batch.num_rows) - common
            yield pa.RecordBatch.from_arrays([batch.column("id_a"), batch.column("id_b"), pa.array(common / np.maximum(union, 1))], names=["id_a", "id_b", "jaccard"])


def sketched(df: DataFrame, order: str, text: str, least_words: int = LEAST_WORDS, k: int = SHINGLE, similarity: float = SIMILARITY, exact: bool = True) -> DataFrame:
    """``FOUND`` rows of each text with enough words: (ord, id, n, bits), where ``id`` hashes its words, so copies share it; and
    beside them the pairs (a, b) of short ids of texts with a key in common, and the members of heavy keys."""
    import numpy as np

    spark = df.sparkSession

    def hashed(rows: DataFrame) -> DataFrame:
        w = rows.select(F.col(order).cast("bigint").alias("ord"), fenced(words_of(F.col(text))).alias("words"))
        n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
        return w.where(n_words >= F.lit(max(least_words, k))).select("ord", F.xxhash64("words").alias("id"), "words")

    n_rows = df.count()
    if exact:
        every = max(1, n_rows // COUNTED_TEXTS)
        some = hashed(df.where(F.pmod(F.xxhash64(F.col(order)), F.lit(every)) == 0))  # for the order only; every text is joined
        found = some.mapInArrow(lambda batches: _count(batches, k), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        counts[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        shared = spark.sparkContext.broadcast(counts)
        keys_of = lambda doc, h, n: _prefix_keys(doc, h, n, similarity, shared.value)
    else:
        keys_of = _band_keys
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows * BANDS // (4 * PART_KEYS) + 1)
    parts = 4 * tasks
    rows = hashed(df).mapInArrow(lambda batches: _sketch(batches, k, parts, keys_of), SKETCHED)
    in_place = IN_PLACE
    return cut(rows.repartition(tasks, "part").mapInArrow(lambda batches: _meet(batches, in_place, similarity), FOUND))


def similar_ids(df: DataFrame, order: str, text: str, sketches: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(id_a, id_b, jaccard), id_a < id_b, of different texts with at least ``similarity`` of their shingles in common."""
    blocks = sketches.where(F.col("heavy").isNotNull()).select("heavy", "members")
    x, y = blocks.withColumnRenamed("members", "x"), blocks.withColumnRenamed("members", "y")
    two = x.join(y, "heavy").where(F.col("x") <= F.col("y")).select("x", "y")
    two = two.repartition(F.xxhash64("x", "y")) if not blocks.isEmpty() else two.limit(0)
    short = sketches.where(F.col("a").isNotNull()).select("a", "b").union(two.mapInArrow(_across, "a bigint, b bigint"))
    short = short.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    facts = sketches.where(F.col("id").isNotNull()).groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("ord").alias("ord"))
    facts = facts.withColumn("short", F.col("id").bitwiseAND(F.lit((1 << ID_BITS) - 1)))
    pairs = short
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("short").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "bits", "ord"))), side)
    hamming = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    bound = (n_a + n_b) * (1 - similarity) / (1 + similarity)
    pairs = cut(pairs.where((F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b)) & (hamming <= bound)).select("id_a", "id_b", "ord_a", "ord_b"))
    # one text of each candidate is read again and its shingles compared exactly
    some = cut(pairs.select(F.col("id_a").alias("id"), F.col("ord_a").alias("ord")).union(pairs.select("id_b", "ord_b")).distinct())
    if some.count() <= MAX_BROADCAST_IDS:
        some = F.broadcast(some)
    texts = df.select(F.col(order).cast("bigint").alias("ord"), F.col(text).alias("__text")).join(some, "ord")
    # words travel as text, which compresses; their shingles are made on the spot
    words = texts.select("id", words_of(F.col("__text")).alias("words"))
    pairs = pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    for side in ("a", "b"):
        pairs = pairs.join(words.withColumnsRenamed({"id": f"id_{side}", "words": f"w_{side}"}), f"id_{side}")
    pairs = pairs.select("id_a", "id_b", "w_a", "w_b").mapInArrow(lambda batches: _compared(batches, k), "id_a bigint, id_b bigint, jaccard double")
    return pairs.where(F.col("jaccard") >= similarity).select("id_a", "id_b", "jaccard")


def similar_pairs(df: DataFrame, order: str, text: str, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, k: int = SHINGLE, exact: bool = True) -> DataFrame:
    """(ord_a, ord_b), ord_a < ord_b: pairs of rows whose texts are alike, copies included; with ``exact`` certainly all of them,
    else with the probabilities that stand above.

    NULL, empty and short texts are in no pair. Texts with the same words are alike whatever their
    letter case and punctuation. ``order`` must name the row.
    """
    found = sketched(df, order, text, least_words, k, similarity, exact)
    ids = similar_ids(df, order, text, found, similarity, k)
    rows = found.where(F.col("id").isNotNull()).select("ord", "id")
    a, b = rows.withColumnsRenamed({"ord": "x", "id": "id_a"}), rows.withColumnsRenamed({"ord": "y", "id": "id_b"})
    different = ids.select("id_a", "id_b").join(a, "id_a").join(b, "id_b")
    copies = a.join(b, F.col("id_a") == F.col("id_b")).where("x < y")
    both = different.select("x", "y").union(copies.select("x", "y"))
    return both.select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"))


def similar_classes(df: DataFrame, order: str, text: str, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, k: int = SHINGLE, exact: bool = True) -> DataFrame:
    """(ord, class_id, n_links): the class of each text with enough words and its links to different texts.

    One row for each row of ``df``, so a class that holds a third of all rows is no burden; ``class_id``
    is the least ``order`` of the class. Copies share a class without links between them.
    """
    found = sketched(df, order, text, least_words, k, similarity, exact)
    ids = cut(similar_ids(df, order, text, found, similarity, k))
    docs = found.where(F.col("id").isNotNull())
    links = ids.select(F.col("id_a").alias("id")).union(ids.select(F.col("id_b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    comps = connected_components(ids, "id_a", "id_b").withColumnRenamed("node", "id")
    rows = docs.select("ord", "id").join(comps, "id", "left").join(links, "id", "left").withColumn("c", F.coalesce("root", "id"))
    rows = cut(rows.select("ord", "c", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return rows.join(rows.groupBy("c").agg(F.min("ord").alias("class_id")), "c").select("ord", "class_id", "n_links")


def _texts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job_cache").select("ord", "description_snippet")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """(ord_a, ord_b): rows whose descriptions share at least half of their different runs of three words."""
    return similar_pairs(_texts(spark, sf_dir), "ord", "description_snippet", exact=False)


def p4_classes(spark, sf_dir: str) -> DataFrame:
    """(ord, class_id, n_links): the near-duplicate class of each description with enough words."""
    return similar_classes(_texts(spark, sf_dir), "ord", "description_snippet", exact=False)
