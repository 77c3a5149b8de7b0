"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Windows of benchmark items are hashed and broadcast; every word window of every document is looked
up, hits are verified word by word, and the words inside any occurrence are hit. The set is counted
before it is gathered: beyond ``MOST_WINDOWS`` it is cut into parts by hash, and the documents are
scanned once per part, so no broadcast ever exceeds that bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.text import (
    ALPHANUMERIC,
    LOWER,
    raw_bytes,
    span_hashes,
    text_slices,
    whole_text,
    window_hashes,
    word_spans,
)
from stationloom.session import checkpointed

WINDOW = 10
#: Most windows that are broadcast at once; about 150 bytes each.
MOST_WINDOWS = 500_000


@dataclass
class _Words:
    """The normalised words of some texts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> _Words:
        data, offsets = raw_bytes(texts)
        data = LOWER[data]
        starts, ends, before = word_spans(data, offsets, ALPHANUMERIC)
        return cls(data, starts, ends, before, span_hashes(data, starts, ends))

    def joined(self, first: int, size: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(
            self.starts[first : first + size], self.ends[first : first + size], strict=True))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            words, out = _Words.of(part.column("text")), []
            ids = part.column("item_id").to_pylist()
            for k, item in enumerate(ids):
                first, stop = int(words.before[k]), int(words.before[k + 1])
                size = min(WINDOW, stop - first)
                if size and item is not None:
                    hashes = window_hashes(words.hashes[first:stop], size)
                    out += [(size, h, words.joined(first + n, size), item) for n, h in enumerate(hashes.view(np.int64).tolist())]
            if out:
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["size", "hash", "words", "item_id"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of all items: ``size, hash, words, item_id``. Items without words, and null ids, have none."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    return rows.mapInArrow(_item_windows, "size int, hash long, words binary, item_id long").distinct()


class HashSet:
    """Sorted window hashes by size, and what stands behind each."""

    def __init__(self, rows: list):
        self.behind: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        for size, h, words, item in rows:
            self.behind.setdefault((size, h), {}).setdefault(bytes(words), []).append(item)
        self.sorted = {
            size: np.sort(np.array([h for s, h in self.behind if s == size], np.int64).view(np.uint64))
            for size in {s for s, _ in self.behind}
        }

    def hits(self, words: _Words) -> Iterator[tuple[int, int, list[int]]]:
        """Verified occurrences: first word, number of words, items."""
        total = len(words.hashes)
        room = np.repeat(words.before[1:], np.diff(words.before)) - np.arange(total)
        for size, known in self.sorted.items():
            hashes = window_hashes(words.hashes, size)
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for at in np.flatnonzero((known[place] == hashes) & (room[: len(hashes)] >= size)).tolist():
                items = self.behind[size, int(hashes[at : at + 1].view(np.int64)[0])].get(words.joined(at, size))
                if items:
                    yield at, size, items


def _scan(hash_set: HashSet, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[set[int]], list[np.ndarray]]:
    """Per text: words, words hit so far, items so far, and which words were hit."""
    words = _Words.of(part.column("text"))
    change = np.zeros(len(words.starts) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(part.num_rows)]
    for at, size, found in hash_set.hits(words):
        change[at] += 1
        change[at + size] -= 1
        items[int(np.searchsorted(words.before, at, side="right")) - 1].update(found)
    hit = np.cumsum(change[:-1]) > 0
    names = part.schema.names
    for k in range(part.num_rows):
        own = slice(words.before[k], words.before[k + 1])
        if "_hit" in names and (before := part.column("_hit")[k].as_py()):
            hit[own] |= np.unpackbits(np.frombuffer(before, np.uint8), count=own.stop - own.start).astype(bool)
        if "_items" in names:
            items[k].update(part.column("_items")[k].as_py() or ())
    sums = np.concatenate([[0], np.cumsum(hit)])
    return np.diff(words.before), np.diff(sums[words.before]), items, [hit[a:b] for a, b in zip(words.before[:-1], words.before[1:], strict=True)]


def _parts(benchmark: DataFrame, most: int) -> tuple[DataFrame, int]:
    windows = checkpointed(item_windows(benchmark))
    return windows, max(1, -(-windows.count() // most))


def _hash_set(windows: DataFrame, part: int, parts: int):
    rows = windows.filter(F.pmod("hash", F.lit(parts)) == part)
    return windows.sparkSession.sparkContext.broadcast(HashSet([tuple(r) for r in rows.collect()]))


def contamination(docs: DataFrame, benchmark: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A window is ten consecutive words of an item; a shorter item is one window. ``n_items`` counts the
    distinct ids of items with an occurring window. Null texts have no words; items with a null id are
    left out. Repeated rows each give a row; an empty table or benchmark is no special case.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    windows, parts = _parts(benchmark, most_windows)
    for part in range(parts):
        known, last = _hash_set(windows, part, parts), part == parts - 1

        def run(batches: Iterator[pa.RecordBatch], known=known, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in text_slices(batch):
                    n_words, n_hit, items, hit = _scan(known.value, piece)
                    if not last:
                        yield pa.RecordBatch.from_arrays(
                            [piece.column("doc_id"), piece.column("text"), pa.array([np.packbits(h).tobytes() for h in hit], pa.binary()),
                             pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], ["doc_id", "text", "_hit", "_items"])
                        continue
                    named = [",".join(sorted(map(str, x))) for x in items]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()),
                         pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named]), pa.array(n_hit > 0)],
                        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        if last:
            return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
        rows = checkpointed(rows.mapInArrow(run, f"doc_id {kind}, text string, _hit binary, _items array<long>"))
    raise AssertionError("no part")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Documents in which no window of any item occurs, with all their columns."""
    windows, parts = _parts(benchmark, most_windows)
    names = docs.columns
    for part in range(parts):
        known = _hash_set(windows, part, parts)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in text_slices(batch):
                    yield piece.filter(pa.array(_scan(known.value, piece.select(["text"]))[1] == 0))

        docs = docs.mapInArrow(run, docs.schema)
        if part < parts - 1:
            docs = checkpointed(docs)
    return docs.select(*[F.col(f"`{c}`") for c in names])
