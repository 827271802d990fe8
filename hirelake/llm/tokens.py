"""Encoding of a corpus with a public byte-level tokenizer.

Texts are split by the tokenizer's own pattern. The different pieces of a batch are bucketed by length
into padded matrices, one row for each piece. In each round every row merges its leftmost pair of
minimum rank; ranks come from a hash table of pairs, the row is closed up behind the merge, and rows
without a pair left are taken out. Pieces longer than the widest bucket are merged alone, all
occurrences of the minimum pair in a round, so that a long run costs rounds by different ranks only.

Encoding is done in executors, batch by batch; the vocabulary is read there from ``path``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.sources.tables import table

DEFAULT_DIR = "/opt/tokenizers"
#: The pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64)
NO_PAIR = 1 << 30
#: Different pieces kept by a worker between batches; beyond it the memory starts anew.
KEEP = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PairTable:
    """A hash table in arrays: (left id, right id) to (rank, merged id), looked up for many pairs at once."""

    def __init__(self, left, right, rank, merged) -> None:
        import numpy as np

        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NO_PAIR, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = left.astype(np.int64) << 32 | right
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several for one slot the last stays
            won = self.keys[at] == keys[todo]
            self.rank[at[won]], self.merged[at[won]] = rank[todo[won]], merged[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, keys):
        import numpy as np

        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """(rank, merged id) of each pair; rank ``NO_PAIR`` where there is none. Negative ids are padding."""
        import numpy as np

        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        rank, merged = np.full(len(keys), NO_PAIR, np.int32), np.zeros(len(keys), np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            on = ~hit & (there >= 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return rank, merged


def understood(said: dict, path: str) -> None:
    """Refuses a vocabulary file that asks for anything but byte-level merges as they are done here."""
    model, before = said.get("model") or {}, said.get("pre_tokenizer") or {}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    asked = {k: model.get(k) or v for k, v in plain.items()}
    fits = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if asked != plain or said.get("normalizer") or not fits or set(byte_letters()) - set(model.get("vocab") or ()):
        raise ValueError(f"{path} is no byte-level vocabulary with the known pattern: normalizer {said.get('normalizer')}, pre-tokenizer {before}, model {asked}")


class Encoder:
    """A byte-level vocabulary file, without special tokens."""

    def __init__(self, path: str) -> None:
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        understood(said, path)
        model = said["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        ranks = np.arange(len(pairs), dtype=np.int32)
        self.table = PairTable(left, right, ranks, merged)
        # the last merge that makes each id; where all pairs with the id come later, merging makes only pairs of higher rank
        made = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(made, merged, ranks)
        self.rising = bool((np.maximum(made[left], made[right]) < ranks).all())
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        pieces = [self.split(t) for t in texts]
        if len(self.known) > KEEP:
            self.known = {}
        known = self.known
        new = {p for ps in pieces for p in ps if p not in known}
        if new:
            self._learn(sorted(new))
        return [[i for p in ps for i in known[p]] for ps in pieces]

    def _learn(self, pieces: list[str]) -> None:
        import numpy as np

        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(b) for b in raw])
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(rows):
                ids = np.full((len(rows), width), -1, np.int32)
                flat = self.of_byte[np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)]
                ids[np.arange(width) < sizes[rows][:, None]] = flat
                for i, merged in zip(rows, self._merge(ids), strict=True):
                    self.known[pieces[i]] = merged
        for i in np.flatnonzero(sizes > low):
            self.known[pieces[i]] = self._merge_long(self.of_byte[np.frombuffer(raw[i], np.uint8)].copy())

    def _merge(self, ids) -> list[tuple[int, ...]]:
        """Ids of each row of a padded matrix after all merges."""
        import numpy as np

        n, width = ids.shape
        rank, to = (x.reshape(n, width - 1) for x in self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        done: list = [None] * n
        rows, cols = np.arange(n), np.arange(width)
        while len(rows):
            j = rank.argmin(axis=1)  # the leftmost of least rank
            here = np.arange(len(rows))
            live = rank[here, j] < NO_PAIR
            if not live.all():
                for r, line in zip(rows[~live].tolist(), ids[~live].tolist(), strict=True):
                    done[r] = tuple(x for x in line if x >= 0)
                rows, ids, rank, to, j = rows[live], ids[live], rank[live], to[live], j[live]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            new = to[here, j]
            # close up: everything behind the pair moves one to the left
            take = np.minimum(cols + (cols > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            ids[here, j] = new
            take = take[:, : width - 1]
            gap = np.minimum(cols[:-1] + (cols[:-1] >= j[:, None]), width - 2)
            rank, to = np.take_along_axis(rank, gap, 1), np.take_along_axis(to, gap, 1)
            rank[:, -1] = NO_PAIR
            for side in (-1, 0):  # only the two pairs that hold the new id change
                at = j + side
                ok = (at >= 0) & (at < width - 1)
                r, m = self.table.find(ids[here[ok], at[ok]], ids[here[ok], at[ok] + 1])
                rank[here[ok], at[ok]], to[here[ok], at[ok]] = r, m
        return done

    def _merge_long(self, ids) -> tuple[int, ...]:
        """One long piece. Where merging a pair makes only pairs of higher rank, all its occurrences go at once, else the leftmost."""
        import numpy as np

        while len(ids) > 1:
            rank, to = self.table.find(ids[:-1], ids[1:])
            least = rank.min()
            if least >= NO_PAIR:
                break
            at = np.flatnonzero(rank == least)
            if ids[at[0]] == ids[at[0] + 1]:  # runs of one id: every second place of a run
                run = np.r_[0, np.cumsum(np.diff(at) != 1)]
                first = at[np.searchsorted(run, run)]
                at = at[(at - first) % 2 == 0]
            if not self.rising:
                at = at[:1]
            ids[at] = to[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
        return tuple(ids.tolist())


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, read once in each worker process."""
    return Encoder(path)


def encoded(df: DataFrame, key: str, text: str, path: str, counts_only: bool = False) -> DataFrame:
    """``key`` and ``ids`` ARRAY<INT> (or ``n_tokens`` BIGINT) of each row of ``df``.

    NULL and empty texts have no ids: an empty list, and 0 tokens. Whole texts are encoded; the strings
    of special tokens are ordinary text. Repeated rows and keys are each kept; an empty table gives none.
    """
    key_type = df.schema[key].dataType.simpleString()
    out = f"`{key}` {key_type}, " + ("n_tokens bigint" if counts_only else "ids array<int>")

    def run(batches: Iterator) -> Iterator:
        import itertools

        import numpy as np
        import pyarrow as pa

        enc = encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids = enc.encode([t or "" for t in batch.column(1).to_pylist()])
                sizes = np.array([len(x) for x in ids], np.int64)
                if counts_only:
                    column = pa.array(sizes)
                else:
                    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
                    column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), column], names=batch.schema.names[:1] + (["n_tokens"] if counts_only else ["ids"]))

    return df.select(key, text).mapInArrow(run, out)


def p7_ids(spark, sf_dir: str, path: str = f"{DEFAULT_DIR}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, ids): the ids of each document by byte_bpe_50k, without special tokens."""
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text", path)


def p7_lengths(spark, sf_dir: str, path: str = f"{DEFAULT_DIR}/byte_bpe_50k.json") -> DataFrame:
    """(lang, n_docs, n_tokens, tokens_per_char): tokens of the corpus by language label."""
    docs = table(spark, sf_dir, "documents")
    sized = encoded(docs, "doc_id", "text", path, counts_only=True)
    rows = docs.select("doc_id", "lang", "n_chars").join(sized, "doc_id")
    totals = rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("__chars"))
    return totals.select("lang", "n_docs", "n_tokens", F.when(F.col("__chars") > 0, F.round(F.col("n_tokens") / F.col("__chars"), 4)).alias("tokens_per_char"))
