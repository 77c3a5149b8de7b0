"""Filters of the 64-bit keys that occur more than once in a corpus.

A task sorts the keys it has gathered, keeps two of each at most, and hands them on as one row of packed keys
per part, a part being a range of keys. So a key takes 8 bytes of shuffle, a hot one no more than two per
gathering, and no key needs a row of its own. The filter of a part is made where the part's keys meet.
Other keys may pass a filter, no wanted one is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.buckets import group_starts, grouped
from stationloom.llm.text import mixed
from stationloom.session import written

#: Ranges of keys, a power of two, and keys that a task gathers before it hands them on.
PARTS, GATHERED = 1 << 10, 1 << 20
#: A filter is broadcast if it takes no more than so many bytes. It has 10 bits a key, or as many as fit, 3 at least.
FILTER_BYTES, MOST_BITS, LEAST_BITS = 64 << 20, 10, 3

Keys = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def _places(keys: np.ndarray, hashes: int) -> Iterator[np.ndarray]:
    h = mixed(keys.view(np.uint64))
    step = mixed(h) | np.uint64(1)
    for _ in range(hashes):
        yield h
        h = h + step


def _part_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)


class KeyFilter:
    """Bits of all parts, one after another; a part without keys has none."""

    def __init__(self, parts: dict[int, bytes], hashes: int):
        size = np.zeros(PARTS, np.int64)
        for p, bits in parts.items():
            size[p] = len(bits) * 8
        self.size, self.begin, self.hashes = size, np.cumsum(size) - size, hashes
        self.bits = np.frombuffer(b"".join(parts[p] for p in sorted(parts)), np.uint8)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        part = _part_of(keys)
        left = np.flatnonzero(self.size[part])
        begin, size, own = self.begin[part[left]], self.size[part[left]].astype(np.uint64), keys[left].view(np.uint64)
        h = mixed(own)
        step = mixed(h) | np.uint64(1)
        for _ in range(self.hashes):
            at = begin + (h % size).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left, begin, size, h, step = left[hit], begin[hit], size[hit], h[hit] + step[hit], step[hit]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


def _gathered(give: Keys, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(kinds)]

        def out(kind: int) -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held[kind]).view(np.uint64))
            held[kind] = []
            third = np.zeros(len(keys), bool)
            third[2:] = keys[2:] == keys[:-2]
            keys = keys[~third]
            own, begin = np.unique(_part_of(keys), return_index=True)
            packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.append(begin, len(keys)).astype(np.int32) * 8), pa.py_buffer(keys)])
            return pa.RecordBatch.from_arrays([pa.array(kind * PARTS + own), packed], ["part", "keys"])

        for batch in batches:
            for kind, keys in give(batch):
                if len(keys):
                    held[kind].append(keys)
                if sum(map(len, held[kind])) >= GATHERED:
                    yield out(kind)
        for kind in range(kinds):
            if held[kind]:
                yield out(kind)

    return run


def _met(least: int):
    """The keys of each part that were handed on ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["part"]):
            starts = group_starts(table, ["part"])
            part, packed = table.column("part").to_numpy(), table.column("keys").combine_chunks()
            for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                keys, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in packed[a:b]]), return_counts=True)
                keys = keys[n >= least]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 1]), pa.array([len(keys)]), pa.array([keys.tobytes()], pa.binary())],
                                                     ["part", "n", "keys"])

    return run


def _bits(bits: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for k in range(batch.num_rows):
                keys = np.frombuffer(batch.column("keys")[k].as_buffer(), np.uint64)
                size = -(-len(keys) * bits // 8)
                marks = np.zeros(size * 8, np.uint8)
                for h in _places(keys, hashes):
                    marks[(h % np.uint64(size * 8)).astype(np.int64)] = 1
                own.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(own, pa.binary())], ["part", "bits"])

    return run


def _filters(packed: DataFrame, kinds: int) -> list:
    """Broadcast filters of ``part, n, keys``, one per kind of key."""
    spark = packed.sparkSession
    totals = {r["kind"]: r["n"] for r in packed.groupBy(F.expr(f"part div {PARTS}").alias("kind")).agg(F.sum("n").alias("n")).collect()}
    out = []
    for kind in range(kinds):
        bits = min(MOST_BITS, FILTER_BYTES * 8 // max(1, totals.get(kind, 0)))
        if bits < LEAST_BITS:
            out.append(None)
            continue
        hashes = max(1, round(bits * np.log(2)))
        own = packed.filter(F.expr(f"part div {PARTS}") == kind).select("part", "keys")
        rows = own.mapInArrow(_bits(bits, hashes), "part long, bits binary").toArrow()
        parts = {p - kind * PARTS: b for p, b in zip(rows["part"].to_pylist(), rows["bits"].to_pylist(), strict=True)}
        out.append(spark.sparkContext.broadcast(KeyFilter(parts, hashes)))
    return out


def _kept(rows: DataFrame, give: Keys, kinds: int, least: int) -> list:
    packed = rows.mapInArrow(_gathered(give, kinds), "part long, keys binary")
    packed = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_met(least), "part long, n long, keys binary")
    return _filters(written(packed, "keys"), kinds)


def repeated_keys(rows: DataFrame, give: Keys, kinds: int) -> list:
    """For each kind of key that ``give`` finds in batches of ``rows``, a broadcast filter of those that occur at
    least twice, or ``None`` where it would be too large."""
    return _kept(rows, give, kinds, 2)


def _first_key(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, batch.column("k1").to_numpy()


def key_filter(keys: DataFrame):
    """A broadcast filter of all ``k1`` of a table, or ``None`` where it would be too large."""
    return _kept(keys.select("k1"), _first_key, 1, 1)[0]
