"""Near-duplicates by SimHash fingerprints, with pivot distance tables.

Equal fingerprints collapse first. The others meet where two of five blocks of their bits agree,
which any two fingerprints at three or fewer differing bits do. In a bucket, the Hamming distances to
many reference fingerprints, computed once per fingerprint, discard a pair as soon as one of these
coordinates differs by more than the limit (triangle inequality); what survives is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.buckets import compare_groups, in_blocks
from stationloom.llm.components import components
from stationloom.llm.exact_dedup import keep_rows
from stationloom.llm.text import LOWER, NOT_SPACE, raw_bytes, text_slices, whole_text, word_spans
from stationloom.session import checkpointed

SHINGLE, SEED, MOST_BITS, PIVOTS = 3, 42, 3, 16
#: Bits of each block, from the lowest.
BLOCKS = (13, 13, 13, 13, 12)
#: Most members of a block of a bucket, and members from which a group is searched row by row.
BLOCK_ROWS, SMALL_GROUP = 2048, 24


def _fingerprints(texts: pa.Array) -> np.ndarray:
    data, offsets = raw_bytes(texts)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, NOT_SPACE)
    # words joined by single spaces, one text after the other, so that a shingle is a slice
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    joined = np.full(at[-1], 32, np.uint8)
    shift = np.repeat(at[:-1] - starts, lengths)
    inside = np.repeat(starts, lengths) + _within(lengths)
    joined[inside + shift] = data[inside]
    joined = joined.tobytes()
    words = np.diff(before)
    shingles = np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0)
    first = np.repeat(before[:-1], shingles) + _within(shingles)
    last = first + np.repeat(np.minimum(words, SHINGLE), shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last + 1] - 1).tolist(), strict=True)),
        np.uint64, len(first))
    out = np.zeros(len(words), np.uint64)
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum(shingles, out=bounds[1:])
    some = np.flatnonzero(shingles)
    if len(some):
        counts = np.empty((len(some), 64), np.int64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int64, out=counts)
        over = 2 * counts > shingles[some, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long), one row per document; null texts are empty, empty ones get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                fp = pa.array(_fingerprints(part.column("text")).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), fp], [*kept, "fp"])

    kept = ["doc_id", "text_sha256"]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    return rows.mapInArrow(run, "doc_id long, text_sha256 string, fp long")


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """``n`` fixed reference fingerprints, spread over the space by a hash."""
    return np.array([xxhash.xxh64_intdigest(b"reference", seed) for seed in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference fingerprint."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def _near(fp: np.uint64, row: np.ndarray, fps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in ``fps`` within the limit of ``fp``: coordinates first, survivors verified."""
    left = np.flatnonzero(np.abs(table[:, 0] - row[0]) <= MOST_BITS)
    for k in range(1, table.shape[1]):
        if len(left) < 8:
            break
        left = left[np.abs(table[left, k] - row[k]) <= MOST_BITS]
    return left[np.bitwise_count(fps[left] ^ fp) <= MOST_BITS]


def _compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges that connect the members of each group as their links do; a group of m gives at most m - 1."""
    fps = table.column("fp").to_numpy().view(np.uint64)
    order = table.column("pivots").combine_chunks()
    coordinates = np.frombuffer(order.buffers()[2], np.int8)[order.offset * PIVOTS :][: len(fps) * PIVOTS].reshape(-1, PIVOTS)
    sizes = np.diff(bounds)
    found_a, found_b = [], []
    # small groups: each row with the next, the one after it, and so on, in all groups at once
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    end = np.repeat(bounds[1:], sizes)
    rows = np.flatnonzero(small)
    for shift in range(1, SMALL_GROUP):
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            break
        pair = rows[np.abs(coordinates[rows] - coordinates[rows + shift]).max(axis=1) <= MOST_BITS]
        pair = pair[np.bitwise_count(fps[pair] ^ fps[pair + shift]) <= MOST_BITS]
        found_a.append(fps[pair])
        found_b.append(fps[pair + shift])
    # large groups: walk from member to member; each is compared once with those not reached yet
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        own, coords = fps[bounds[g] : bounds[g + 1]], coordinates[bounds[g] : bounds[g + 1]]
        left = np.arange(len(own))
        while len(left):
            reached, left = [int(left[0])], left[1:]
            while reached and len(left):
                x = reached.pop()
                near = _near(own[x], coords[x], own[left], coords[left])
                if len(near):
                    found_a.append(np.full(len(near), own[x]))
                    found_b.append(own[left[near]])
                    reached.extend(left[near].tolist())
                    left = np.delete(left, near)
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivots = reference_fingerprints()
    for batch in batches:
        table = pivot_table(batch.column("fp").to_numpy().view(np.uint64), pivots)
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(table), [None, pa.py_buffer(table.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("fp"), flat.cast(pa.binary())], ["fp", "pivots"])


def _block_keys() -> F.Column:
    """One key for every two of the blocks: which two, and their bits."""
    at = np.cumsum((0, *BLOCKS))
    keys = []
    for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        low = F.shiftrightunsigned("fp", int(at[i])).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))
        high = F.shiftrightunsigned("fp", int(at[j])).bitwiseAND(F.lit((1 << BLOCKS[j]) - 1))
        keys.append(F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(high, 16)).bitwiseOR(low))
    return F.array(*keys)


def simhash_components(fps: DataFrame) -> DataFrame:
    """``fp, component, component_id`` for ``doc_id, fp``: the smallest fingerprint and the smallest id reachable.

    Null ids are larger than any other; a component of null ids only has a null one.
    """
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    keyed = nodes.select("fp").mapInArrow(_with_pivots, "fp long, pivots binary").select(
        "fp", "pivots", F.explode(_block_keys()).alias("bucket"))
    edges = compare_groups(in_blocks(keyed, "bucket", "fp", BLOCK_ROWS), "bucket", _compare, "a long, b long")
    linked = components(edges)
    placed = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    first = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return placed.join(first, "component").select("fp", "component", "component_id")


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, text_sha256``.

    Texts without words have fingerprint zero and link like any other. Repeated rows each give a row.
    An empty table gives an empty result; other columns of ``docs`` aren't read.
    """
    fps = checkpointed(fingerprints(docs, id_column, text_column))
    return fps.join(simhash_components(fps), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_sha256")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id (a null one last), with all its columns.

    An id that stands for several texts of a component stays with the one of the smallest fingerprint and hash.
    """
    fps = checkpointed(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_sha256")
    stays = fps.groupBy("fp").agg(F.min(order).alias("_first")).join(simhash_components(fps), "fp")
    stays = stays.groupBy("component").agg(F.min("_first").alias("_first"))
    return keep_rows(docs, stays.select("_first.doc_id", "_first.text_sha256"))
