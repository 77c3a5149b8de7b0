"""Words and hashes of a whole Arrow batch of texts at once, on the raw UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are looked at together; a longer text is looked at alone.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words, given the ranges that separate them."""
    keep = np.ones(256, dtype=bool)
    for low, high in separators:
        keep[low : high + 1] = False
    return keep


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing
ALPHANUMERIC = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column in a row, and where each text begins (one more than there are texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text. No word crosses texts."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[offsets < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[offsets > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as far as needed."""

    def __init__(self, base: int):
        self.pair = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.bases = (base, pow(base, -1, 1 << 64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k, base in enumerate(self.bases):
            have = self.pair[k]
            while len(have) < n:
                step = np.uint64(pow(base, len(have), 1 << 64))
                have = np.concatenate([have, have * step])
            self.pair[k] = have
        return self.pair[0][:n], self.pair[1][:n]


_POWERS = {base: _Powers(base) for base in (_BASE, _STEP, _BASE ^ _STEP ^ 1)}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for every span, from one running sum."""
    powers, inverse = _POWERS[base].upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def window_hashes(words: np.ndarray, size: int, base: int = _STEP) -> np.ndarray:
    """A hash of every run of ``size`` word hashes; texts aren't told apart."""
    n = max(0, len(words) - size + 1)
    starts = np.arange(n)
    return span_hashes(words, starts, starts + size, base)


#: A second, independent base for 128-bit keys.
SECOND = _BASE ^ _STEP ^ 1
