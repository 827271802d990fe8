"""How often a phrase goes on and how often it ends, counted over all texts for the phrases asked for.

A text that stops at ``... ready for kuber`` asks about its last letters behind their one or two words
before. Each place of each text answers: the same letters behind the same words go on there (inside the
word or with another word of the sentence), or they end a finished sentence or line. Places are compared by
hashes of bytes: prefix sums of byte values times powers give the hash of any run of bytes
in one step, so a batch of texts is a few passes over flat arrays. Answers are summed in each task before
they are shuffled. A bitmap of fixed size of the asked keys only keeps places that nobody asks about
out of the shuffle; the join with the asked keys is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hirelake.llm.bytewords import ROW_END, prefix_sums, slices, word_starts

SLOT_BITS = 27  # of the bitmap: 16 MB whatever the input
BUCKET_BITS = 15  # of a bucket of bitmap_construct_agg
START_WORDS = 4
_DOTS = 5
# Characters of several bytes, and the byte that stands for them: closing marks of wide scripts and the ellipsis by
# bytes of their own, quotes, bullets and blanks by plain ones.
_WIDE = {
    "。": 1, "！": 2, "？": 3, "…": _DOTS, "”": ord('"'), "“": ord('"'), "»": ord('"'), "«": ord('"'), "’": ord("'"), "‘": ord("'"),
    "•": ord("*"), "·": ord("*"), "▪": ord("*"), "◦": ord("*"), "–": ord("*"), "\u00a0": 32, "\u200b": 32, "\ufeff": 32,
}


def flat(text: Column) -> Column:
    """Lower case, line ends for ``<br>``; the rest is done on bytes by :func:`_plain`."""
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("<br")), F.regexp_replace(t, r" *<br *\/?> *", "\n")).otherwise(t)


@cache
def _bytes():
    """The byte for each single byte: digits as 0, blanks as a space; and the characters of ``_WIDE`` by their length."""
    import numpy as np

    plain = np.arange(256, dtype=np.uint8)
    plain[49:58] = 48
    plain[[9, 13]] = 32
    return plain, [(np.frombuffer(c.encode(), np.uint8), to) for c, to in _WIDE.items()]


def _plain(b):
    """A buffer of flat texts with single bytes for the characters of ``_WIDE`` and all digits alike."""
    import numpy as np

    plain, wide = _bytes()
    b = plain[b]
    leads = np.flatnonzero((b == 0xE2) | (b == 0xC2) | (b == 0xE3) | (b == 0xEF))
    leads = leads[leads < len(b) - 2]
    if not len(leads):
        return b
    drop = np.zeros(len(b), bool)
    first, second, third = b[leads], b[leads + 1], b[leads + 2]
    for code, to in wide:
        hit = (first == code[0]) & (second == code[1])
        if len(code) == 3:
            hit &= third == code[2]
        at = leads[hit]
        b[at] = to
        for k in range(1, len(code)):
            drop[at + k] = True
    return b[~drop] if drop.any() else b


@cache
def _tables():
    import numpy as np

    is_in = lambda xs: np.isin(np.arange(256), list(xs))
    closers = [*b".!?\"')]:", 1, 2, 3, _DOTS]
    return is_in(closers), is_in(b".!?"), is_in([1, 2, 3])


def _mix(k):
    import numpy as np

    k = (k ^ k >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ k >> np.uint64(29)


class _Scan:
    """Words, sentences and hashes of a buffer of texts, each closed by the byte ``ROW_END``."""

    def __init__(self, b) -> None:
        import numpy as np

        self.bytes = b = _plain(b)
        is_closer, is_mark, is_wide_mark = _tables()
        begins, sep = word_starts(b)
        at = np.flatnonzero(begins)  # first byte of each word
        self.place = np.flatnonzero(~sep)
        self.word = (np.cumsum(begins)[self.place] - 1).astype(np.int32)
        size = np.bincount(self.word, minlength=len(at))
        end = at + size - 1
        own = np.cumsum(size) - size  # where the places of a word begin
        # sentences
        lines, rows = np.cumsum(b == 10, dtype=np.int32), np.cumsum(b == ROW_END, dtype=np.int32)
        last = b[end]
        row_over = rows[at[1:]] > rows[end[:-1]]
        over = row_over | (lines[at[1:]] > lines[end[:-1]]) | is_mark[last[:-1]] & (at[1:] > end[:-1] + 1) | is_wide_mark[last[:-1]]
        first, self.closes, self.ends_row = np.r_[True, over], np.r_[over, True], np.r_[row_over, True]
        # hash of each word up to each of its places
        sums, before, scale = prefix_sums(b, at)
        self.hash = (sums[self.place] - before[self.word]) * scale[self.word]
        # the word without closing marks and quotes, and whether there was a closing mark
        closer = is_closer[b[self.place]]
        core = np.maximum.reduceat(np.where(closer, -1, self.place), own) if len(at) else at
        self.core = np.where(core < 0, end, core)
        dots = (last == 46) & (np.r_[b[:1], b[:-1]][end] == 46) & (np.r_[b[:2], b[:-2]][end] == 46)
        marks = np.r_[0, np.cumsum(is_mark[b] | is_wide_mark[b], dtype=np.int32)]
        self.closed = (marks[end + 1] > marks[self.core + 1]) & ~dots
        whole = self.hash[own + size - 1]
        self.stem = self.hash[own + self.core - at]
        # what stands before: the word before, and the two before, within the sentence
        begin = np.uint64(0xB5)
        one = np.where(first, begin, np.r_[begin, whole[:-1]])
        two = np.where(first | np.r_[True, first[:-1]], begin, np.r_[begin, begin, whole[:-2]][: len(at)])
        index = np.arange(len(at))
        opens = np.maximum.accumulate(np.where(first, index, 0))  # the first word of the sentence
        # list items end where running text goes on, so they are asked about among themselves
        item = ((size == 1) & ((b[at] == 42) | (b[at] == 45)))[opens].astype(np.uint64) << np.uint64(32)
        one = one + item
        self.one = _mix(one * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        self.two = _mix(_mix(two) * np.uint64(0x165667B19E3779F9) + one * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2))
        # beginnings of sentences: their first words
        self.fourth = np.flatnonzero(index - opens == START_WORDS - 1)
        k = np.zeros(len(self.fourth), np.uint64)
        for i in range(START_WORDS):
            k = _mix(k + self.stem[self.fourth - (START_WORDS - 1 - i)] + np.uint64(3))
        self.start_keys = k

    def keys(self, context, word, h):
        import numpy as np

        return _mix(context[word] + h * np.uint64(0x27D4EB2F165667C5))


def asked_keys(rows: DataFrame, last: str) -> DataFrame:
    """``rows`` with key_two, key_one (the last word behind its two words, its one word) and key_start (the first words;
    NULL below four) of the flat sentence in ``last``, which holds a word."""
    kept = rows.drop(last).schema
    names = list(kept.names)
    schema = StructType([*kept.fields, *(StructField(c, LongType()) for c in ("key_two", "key_one", "key_start"))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            two, one, start = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            has_start = np.zeros(batch.num_rows, bool)
            for row, _, b in slices(batch.column(batch.schema.get_field_index(last))):
                s = _Scan(b)
                b = s.bytes
                final = np.flatnonzero(s.ends_row)
                at = row + np.cumsum(b == ROW_END)[s.core[final]]  # texts without a word keep 0
                two[at], one[at] = (s.keys(c, final, s.stem[final]).view(np.int64) for c in (s.two, s.one))
                from_row = row + np.cumsum(b == ROW_END)[s.core[s.fourth]]
                start[from_row[::-1]], has_start[from_row] = s.start_keys.view(np.int64)[::-1], True
            made = [pa.array(two), pa.array(one), pa.array(start, mask=~has_start)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *made], names=[*names, "key_two", "key_one", "key_start"])

    return rows.mapInArrow(run, schema)


def key_bitmap(keys: DataFrame):
    """A broadcast bitmap, 16 MB whatever the number of keys, in which the slot of each ``key`` is set."""
    import numpy as np

    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    slots = keys.select(F.shiftright(slot, BUCKET_BITS).cast("int").alias("bucket"), slot.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("bit"))
    found = slots.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # at most 4096 rows of 4 KB
    bits = np.zeros((1 << SLOT_BITS - BUCKET_BITS, 1 << BUCKET_BITS - 3), np.uint8)
    for r in found:
        bits[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def evidence(texts: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """(key, n_on, n_end): of each asked ``key`` how often its phrase goes on in the flat texts, and how often it ends.

    Behind two words, a phrase ends with a closed sentence or an inner line. One word before says too little about
    sentences, so there only the word itself counts: whether its letters go on, or are a whole word.
    Of a beginning, ``n_on`` says how many sentences begin so.

    The last word of a text without a closing mark answers nothing. NULL texts answer nothing; repeated keys count once.
    """
    asked = asked.select("key").where(F.col("key").isNotNull()).distinct()
    shared = key_bitmap(asked)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits = shared.value

        def hit(k):
            slot = (k >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            return np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)

        for batch in batches:
            on, ends = [], []
            for _, _, b in slices(batch.column(0).drop_null()):
                s = _Scan(b)
                b = s.bytes
                silent = s.ends_row & ~s.closed
                for context in (s.two, s.one):
                    k = s.keys(context, s.word, s.hash)
                    i = hit(k)
                    w, p = s.word[i], s.place[i]
                    final = s.closes[w]
                    inside_number = (b[p] == 48) & (b[p + 1] == 48)  # 4 goes on to 40, but need not
                    says, stops = ~silent[w] & ~inside_number & ~(final & (p > s.core[w])), p == s.core[w]
                    if context is s.two:
                        stops &= final
                    on.append(k[i[says & ~stops]])
                    ends.append(k[i[says & stops]])
                on.append(s.start_keys[hit(s.start_keys)])
            if not on:
                continue
            (a, n_a), (z, n_z) = (np.unique(np.concatenate(x), return_counts=True) for x in (on, ends))
            zero = lambda x: np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, z].view(np.int64)), pa.array(np.r_[n_a, zero(z)]), pa.array(np.r_[zero(a), n_z])], names=["key", "n_on", "n_end"])

    counted = texts.select(text).mapInArrow(run, "key long, n_on long, n_end long")
    return counted.groupBy("key").agg(F.sum("n_on").alias("n_on"), F.sum("n_end").alias("n_end")).join(asked, "key", "left_semi")
