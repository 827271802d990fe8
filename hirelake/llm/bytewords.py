"""Words of flat texts and their hashes, straight from the bytes of a batch.

Prefix sums of byte values times powers give the hash of any run of bytes in one step. Words stand between spaces; a Han
character is a word of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

SLICE = 1 << 20  # bytes of text worked on at once
ROW_END = 4
POWER, INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: list = []


@cache
def tables():
    """Byte values for hashes; which bytes stand between words; which begin a Han character."""
    import numpy as np

    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ z >> np.uint64(27), np.isin(np.arange(256), [32, 10, ROW_END]), np.isin(np.arange(256), list(range(0xE4, 0xEA)))


def powers(n: int):
    import numpy as np

    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + (SLICE >> 1))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)]) for base in (POWER, INVERSE)]
    return _powers


def slices(column) -> Iterator:
    """(first row, number of rows, bytes) of about ``SLICE`` bytes of texts, each closed by ``ROW_END``. No text may be NULL."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(column):
        return
    joined = pc.binary_join_element_wise(pc.cast(column, pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(chr(ROW_END), pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, stop - row, data[offsets[row] : offsets[stop]]
        row = stop


def word_starts(b, split_han: bool = True):
    """(first byte of each word, whether a byte stands between words)."""
    import numpy as np

    _, is_sep, is_han = tables()
    sep = is_sep[b]
    begins = np.r_[True, sep[:-1]]
    if split_han:
        han = is_han[b]
        begins |= han
        begins[3:] |= han[:-3]
    begins &= ~sep
    return begins, sep


def prefix_sums(b, at):
    """(sums, sum before each word, scale of each word): (sums[p] - before) * scale is the hash of a word up to its byte p."""
    import numpy as np

    value = tables()[0]
    power, inverse = powers(len(b))
    sums = np.cumsum(value[b] * power[: len(b)])
    return sums, np.where(at > 0, sums[at - 1], np.uint64(0)), inverse[at]


def word_hashes(b, split_han: bool = True):
    """(hash, row, is Han) of each word of a buffer of :func:`slices`; without ``split_han`` Han characters make words like others."""
    import numpy as np

    begins, sep = word_starts(b, split_han)
    at = np.flatnonzero(begins)
    size = np.bincount(np.cumsum(begins)[~sep] - 1, minlength=len(at))
    sums, before, scale = prefix_sums(b, at)
    return (sums[at + size - 1] - before) * scale, np.cumsum(b == ROW_END)[at], tables()[2][b[at]]
