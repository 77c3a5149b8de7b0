"""Passages that repeat across documents: paragraph MinHash banding, and shared runs of words.

Paragraphs are lines of ``SHINGLE`` words or more: their MinHash bands are tuned for high recall at the wanted
similarity, colliding lines are compared by the exact Jaccard similarity of their five-word shingles, and
connected ones are a cluster. And, since passages are also pasted into the middle of other text, all runs of
``LEAST_WORDS`` words that documents share, wherever they stand: each holds a seed, a stretch of ``SEED_WORDS``
words at a content-defined anchor, and around seeds that documents share, every run of ``LEAST_WORDS`` words is
looked up by a 128-bit key, once for all equal stretches of such runs. A longer passage is the union of its runs,
so it is covered from the first shared word to the last. Filters of the keys that occur twice (``repeated.py``)
spare what nothing else shares; results don't depend on them. A cluster or run stays in the document with the smallest id and is removed elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationloom.llm.buckets import compare_groups, in_blocks
from stationloom.llm.components import components
from stationloom.llm.repeated import key_filter, repeated_keys
from stationloom.llm.text import (
    ALPHANUMERIC,
    LOWER,
    SECOND,
    mixed,
    raw_bytes,
    span_hashes,
    text_slices,
    whole_text,
    window_hashes,
    word_spans,
)
from stationloom.session import checkpointed, written

SHINGLE, SIMILARITY, LEAST_WORDS = 5, 0.8, 30
#: Any run of ``ANCHOR_WINDOW + SEED_WORDS - 1`` words, fewer than ``LEAST_WORDS``, holds a seed.
SEED_WORDS, ANCHOR_WINDOW = 15, 15
#: At similarity 0.8, bands of so many rows miss 3 pairs in 1000; at 0.9, 3 in 100,000.
BANDS, BAND_ROWS = 8, 3
BLOCK_ROWS = 512
#: Runs of a stretch; a longer one is cut.
STRETCH_RUNS = 4096
SEEDS, BUCKETS = 0, 1
_NO_ID = -(1 << 63)


class _Part:
    """Words, shingles, lines and anchors of some texts."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = raw_bytes(texts)
        self.data = LOWER[self.raw]
        self.starts, self.ends, self.before = word_spans(self.data, self.offsets, ALPHANUMERIC)
        self.words = span_hashes(self.data, self.starts, self.ends)
        self.shingles = window_hashes(self.words, SHINGLE)

    def keys(self, first: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """Two independent hashes of stretches of words."""
        return [self.key(first, stop), span_hashes(self.words, first, stop, SECOND).view(np.int64)]

    def key(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first of them."""
        return span_hashes(self.words, first, stop, 0xD6E8FEB86659FD93).view(np.int64)

    def text_of(self, first: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.before, first, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of every line that has a shingle."""
        if not len(self.starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        number = np.searchsorted(np.flatnonzero(self.raw == 10), self.starts)
        new = np.ones(len(number), bool)
        new[1:] = number[1:] != number[:-1]
        new[self.before[:-1][self.before[:-1] < len(number)]] = True
        first = np.flatnonzero(new)
        stop = np.append(first[1:], len(number))
        long = stop - first >= SHINGLE
        return first[long], stop[long]

    def anchors(self) -> np.ndarray:
        """Words at which the smallest shingle hash of some window of shingles stands, with room for a seed."""
        v = self.shingles
        n = len(v) - ANCHOR_WINDOW + 1
        if n <= 0:
            return np.empty(0, np.int64)
        at, size = np.arange(len(v)), 1
        while size < ANCHOR_WINDOW:  # the leftmost smallest of ever longer windows
            step = min(size, ANCHOR_WINDOW - size)
            left, right = at[:-step], at[step:]
            at, size = np.where(v[left] <= v[right], left, right), size + step
        end = np.repeat(self.before[1:], np.diff(self.before))
        first = np.arange(n)
        found = np.unique(at[first[first + ANCHOR_WINDOW + SHINGLE - 1 <= end[first]]])
        return found[found + SEED_WORDS <= end[found]]

    def runs(self, seeds: np.ndarray) -> np.ndarray:
        """Where the runs of ``LEAST_WORDS`` words that hold one of the seeds begin."""
        text = self.text_of(seeds)
        first = np.maximum(seeds + SEED_WORDS - LEAST_WORDS, self.before[text])
        last = np.minimum(seeds, self.before[text + 1] - LEAST_WORDS)
        first, last = first[first <= last], last[first <= last]
        change = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, last + 1, -1)
        return np.flatnonzero(np.cumsum(change) > 0)

    def bands(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Band hashes of lines: the minima of permuted shingle hashes, a few at a time."""
        counts = stop - first - SHINGLE + 1
        begin = np.cumsum(counts) - counts
        own = self.shingles[np.arange(counts.sum()) - np.repeat(begin, counts) + np.repeat(first, counts)]
        out = np.empty((len(first), BANDS), np.uint64)
        for band in range(BANDS):
            total = np.full(len(first), band + 1, np.uint64)
            for row in range(BAND_ROWS):
                salt = mixed(np.array([band * BAND_ROWS + row + 1], np.uint64))[0]
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mixed(own ^ salt), begin))
            out[:, band] = total
        return out.view(np.int64)


Wanted = Callable[[np.ndarray], np.ndarray] | None


def _passing(only) -> Wanted:
    return None if only is None else only.value.passes


def _mapped(docs: DataFrame, give: Callable[[_Part, pa.RecordBatch, Wanted], list[pa.Array] | None], names: list[str], schema: str,
            only=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _passing(only)
        for batch in batches:
            for part in text_slices(batch):
                columns = give(_Part(part.column("text")), part, wanted)
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def _in_text(part: _Part, first: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which stretches are the first with their key in their text."""
    text = part.text_of(first)
    order = np.lexsort((keys, text))
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(keys[order]) != 0)
    return order[new]


def _seeds_and_buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Keys of seeds, once per text, and buckets of lines, of each distinct line of a text."""
    for slice_ in text_slices(batch):
        part = _Part(slice_.column("text"))
        at = part.anchors()
        k1 = part.key(at, at + SEED_WORDS)
        yield SEEDS, k1[_in_text(part, at, k1)]
        first, stop = part.lines()
        if len(first):
            own = _in_text(part, first, part.key(first, stop))
            yield BUCKETS, part.bands(first[own], stop[own]).ravel()


def _runs(part: _Part, wanted: Wanted) -> np.ndarray:
    """Runs around the wanted seeds."""
    at = part.anchors()
    return part.runs(at[wanted(part.key(at, at + SEED_WORDS))] if wanted and len(at) else at)


def _run_keys(seeds):
    def give(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """Keys of the runs around wanted seeds, once per text."""
        for slice_ in text_slices(batch):
            part = _Part(slice_.column("text"))
            at = _runs(part, _passing(seeds))
            k1 = part.key(at, at + LEAST_WORDS)
            yield 0, k1[_in_text(part, at, k1)]

    return give


def _stretches(seeds):
    """Maximal stretches of wanted runs: key of their words, place, and the keys of their runs."""

    def give(part: _Part, batch: pa.RecordBatch, wanted: Wanted) -> list[pa.Array] | None:
        at = _runs(part, _passing(seeds))
        if wanted and len(at):
            at = at[wanted(part.key(at, at + LEAST_WORDS))]
        if not len(at):
            return None
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1] + 1
        begin = np.flatnonzero(new)
        since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(since % STRETCH_RUNS == 0)
        n = np.diff(np.append(begin, len(at)))
        first = at[begin]
        text = part.text_of(first)
        keys = np.ascontiguousarray(np.stack(part.keys(at, at + LEAST_WORDS), 1))
        runs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(at)).astype(np.int32) * 16), pa.py_buffer(keys)])
        return [*map(pa.array, part.keys(first, first + n + LEAST_WORDS - 1)), batch.column("doc_id").take(pa.array(text)),
                batch.column("row").take(pa.array(text)), pa.array(first - part.before[text]), pa.array(n), runs]

    return give


def _distinct_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Keys of the runs of each stretch, once each."""
    for runs in batch.column("runs"):
        yield 0, np.unique(np.frombuffer(runs.as_buffer(), np.int64)[::2])


def _doubtful(only):
    """Runs of stretches that pass a filter: those that may stand in another stretch too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _passing(only)
        for batch in batches:
            for a in range(batch.num_rows):
                keys = np.frombuffer(batch.column("runs")[a].as_buffer(), np.int64).reshape(-1, 2)
                at = np.flatnonzero(wanted(keys[:, 0])) if wanted else np.arange(len(keys))
                if len(at):
                    own = [pa.repeat(batch.column(c)[a], len(at)) for c in ("s1", "s2", "low", "high")]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, keys[at].T.copy()), pa.array(at)], ["s1", "s2", "low", "high", "k1", "k2", "at"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch, the ranges of shared runs that stay in the same document."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            keep, high = np.full(r["n"], r["low"]), np.full(r["n"], r["high"])
            for x in r["others"] or ():
                keep[x["at"]], high[x["at"]] = x["keep"], x["high"]
            shared = keep < high
            change = np.ones(r["n"], bool)
            change[1:] = (keep[1:] != keep[:-1]) | (shared[1:] != shared[:-1])
            begin = np.flatnonzero(change)
            stop = np.append(begin[1:], r["n"])
            out += [(r["s1"], r["s2"], a, b, keep[a]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True) if shared[a]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["s1", "s2", "a", "b", "keep"])


def shared_runs(rows: DataFrame, seeds, runs) -> DataFrame:
    """Where runs of ``LEAST_WORDS`` words stand that two ids share: ``doc_id, row, first, stop, keep``.

    Equal stretches are looked at once: of their runs, only those that other stretches may hold too are looked up.
    """
    columns = "s1 long, s2 long, doc_id long, row long, first long, n long, runs binary"
    placed = written(_mapped(rows, _stretches(seeds), [c.split()[0] for c in columns.split(", ")], columns, runs), "stretches")
    stretches = placed.groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("n").alias("n"), F.first("runs").alias("runs"))
    stretches = written(stretches, "distinct-stretches")
    (only,) = repeated_keys(stretches.select("runs"), _distinct_runs, 1)
    doubtful = written(stretches.select("s1", "s2", "low", "high", "runs").mapInArrow(
        _doubtful(only), "s1 long, s2 long, low long, high long, k1 long, k2 long, at long"), "doubtful-runs")
    known = doubtful.groupBy("k1", "k2").agg(F.min("low").alias("keep"), F.max("high").alias("high"))
    others = doubtful.select("s1", "s2", "k1", "k2", "at").join(known, ["k1", "k2"])
    others = others.groupBy("s1", "s2").agg(F.collect_list(F.struct("at", "keep", "high")).alias("others"))
    segments = stretches.select("s1", "s2", "low", "high", "n").join(others, ["s1", "s2"], "left")
    segments = written(segments.mapInArrow(_segments, "s1 long, s2 long, a long, b long, keep long"), "segments")
    found = placed.select("s1", "s2", "doc_id", "row", "first").join(segments, ["s1", "s2"])
    return found.select("doc_id", "row", (F.col("first") + F.col("a")).alias("first"),
                        (F.col("first") + F.col("b") + (LEAST_WORDS - 1)).alias("stop"), "keep")


def _lines(part: _Part, batch: pa.RecordBatch, wanted: Wanted) -> list[pa.Array] | None:
    return _placed(part, batch, *part.lines(), wanted)


def _placed(part: _Part, batch: pa.RecordBatch, first: np.ndarray, stop: np.ndarray, wanted: Wanted) -> list[pa.Array] | None:
    """Keys and places; words are counted within their text."""
    if not len(first):
        return None
    k1, k2 = part.keys(first, stop)
    if wanted:
        hit = wanted(k1)
        first, stop, k1, k2 = first[hit], stop[hit], k1[hit], k2[hit]
    text = part.text_of(first)
    return [pa.array(k1), pa.array(k2), batch.column("doc_id").take(pa.array(text)), batch.column("row").take(pa.array(text)),
            pa.array(first - part.before[text]), pa.array(stop - part.before[text])]


def _banded(part: _Part, batch: pa.RecordBatch, wanted: Wanted) -> list[pa.Array] | None:
    """Lines that share a bucket with another line or place, with those of their buckets."""
    first, stop = part.lines()
    if not len(first):
        return None
    bands = part.bands(first, stop)
    shared = wanted(bands.ravel()).reshape(bands.shape) if wanted else np.ones(bands.shape, bool)
    some = shared.any(1)
    first, stop, bands, shared = first[some], stop[some], bands[some], shared[some]
    offsets = np.append(0, np.cumsum(shared.sum(1))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[shared]))
    return [*map(pa.array, part.keys(first, stop)), batch.column("doc_id").take(pa.array(part.text_of(first))), lists]


def _buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, batch.column("bands").flatten().to_numpy(zero_copy_only=False)


def _in_buckets(only):
    """A row for each bucket of a line that another line may be in too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _passing(only)
        for batch in batches:
            bands = batch.column("bands")
            bucket, row = bands.flatten(), np.repeat(np.arange(len(bands)), bands.value_lengths().to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(wanted(bucket.to_numpy(zero_copy_only=False))) if wanted else np.arange(len(bucket))
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("k1", "k2", "node")), bucket.take(pa.array(hit))],
                                             ["k1", "k2", "node", "bucket"])

    return run


def _line_words(part: _Part, batch: pa.RecordBatch, wanted: Wanted) -> list[pa.Array] | None:
    first, stop = part.lines()
    if not len(first):
        return None
    k1, k2 = part.keys(first, stop)
    if wanted:
        hit = wanted(k1)
        first, stop, k1, k2 = first[hit], stop[hit], k1[hit], k2[hit]
    words = [b" ".join(part.data[a:b].tobytes() for a, b in zip(part.starts[i:j], part.ends[i:j], strict=True)) for i, j in zip(first, stop, strict=True)]
    return [pa.array(k1), pa.array(k2), pa.array(words, pa.binary())]


def _shingle_set(words: bytes) -> set[tuple[bytes, ...]]:
    w = words.split(b" ")
    return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False))


def _similar(a: set, b: set) -> bool:
    low, high = sorted((len(a), len(b)))
    if low < SIMILARITY * high:
        return False
    both = len(a & b)
    return both >= SIMILARITY * (low + high - both)


def _compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges that connect the lines of each group as their links do: each line is compared with those not reached yet."""
    nodes, words = table.column("node"), table.column("words")
    found: list[tuple[str, str]] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = [(nodes[k].as_py(), _shingle_set(words[k].as_py())) for k in range(a, b)]
        while own:
            reached, own = [own[0]], own[1:]
            while reached and own:
                node, shingles = reached.pop()
                near = [_similar(shingles, s) for _, s in own]
                new = [x for x, hit in zip(own, near, strict=True) if hit]
                found += [(node, x[0]) for x in new]
                reached += new
                own = [x for x, hit in zip(own, near, strict=True) if not hit]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["a", "b"])


def line_links(docs: DataFrame, shared=None) -> tuple[DataFrame, DataFrame]:
    """Distinct long lines (``node`` with the smallest and largest id that holds it), and verified links between them.

    With a filter of shared buckets, lines that are in none of them are left out: they have no links and stand once.
    """
    node = F.concat(F.hex("k1"), F.lit("-"), F.hex("k2"))
    banded = _mapped(docs, _banded, ["k1", "k2", "doc_id", "bands"], "k1 long, k2 long, doc_id long, bands array<long>", shared)
    nodes = banded.groupBy("k1", "k2", "bands").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    nodes = checkpointed(nodes.withColumn("node", node))
    (only,) = repeated_keys(nodes.select("bands"), _buckets, 1)
    buckets = nodes.select("k1", "k2", "node", "bands").mapInArrow(_in_buckets(only), "k1 long, k2 long, node string, bucket long")
    buckets = checkpointed(in_blocks(buckets, "bucket", "node", BLOCK_ROWS))
    wanted = checkpointed(buckets.select("k1", "k2").distinct())
    words = _mapped(docs, _line_words, ["k1", "k2", "words"], "k1 long, k2 long, words binary", key_filter(wanted))
    words = words.join(wanted, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    dealt = buckets.join(words, ["k1", "k2"]).select("bucket", "_i", "_j", "node", "words")
    return nodes, compare_groups(dealt, "bucket", _compare, "a string, b string")


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per repeated passage of a document: ``doc_id, first_word, n_words, keep_id, kept``.

    A passage repeats when it, or one as similar as 0.8, stands in documents of at least two ids; documents
    without any have no row. Words are runs of letters and digits, lower-cased in A-Z. ``keep_id`` is the smallest
    id among the documents that hold the passage; there it is ``kept``, elsewhere it can be removed. Overlapping
    passages are one. Null texts are empty; null ids are one id that is smaller than any other; repeated rows of
    one id and text count once; an empty table gives no rows; other columns aren't read.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc_id"), whole_text(text_column).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    names = ["k1", "k2", "doc_id", "row", "first", "stop"]
    schema = "k1 long, k2 long, doc_id long, row long, first long, stop long"
    rows = rows.select("doc_id", "row", "text")
    seeds, buckets = repeated_keys(rows.select("text"), _seeds_and_buckets, 2)
    (runs,) = repeated_keys(rows.select("text"), _run_keys(seeds), 1)
    found = shared_runs(rows, seeds, runs)

    nodes, links = line_links(rows.select("doc_id", "text"), buckets)
    linked = components(links)
    nodes = nodes.select("k1", "k2", "node", "low", "high").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    clusters = nodes.groupBy("component").agg(F.min("low").alias("keep"), F.max("high").alias("_high")).filter("keep < _high")
    clusters = checkpointed(nodes.join(clusters.drop("_high"), "component").select("k1", "k2", "keep"))
    lines = _mapped(rows, _lines, names, schema, key_filter(clusters)).join(clusters, ["k1", "k2"])

    columns = ["doc_id", "row", "first", "stop", "keep"]
    spans = found.select(*columns).unionAll(lines.select(*columns)).withColumn("kept", F.col("doc_id") == F.col("keep"))
    own = Window.partitionBy("doc_id", "row", "kept").orderBy("first", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(F.col("first") <= reach, 0).otherwise(1))
    spans = spans.withColumn("_span", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "row", "kept", "_span").agg(F.min("first").alias("first_word"), F.max("stop").alias("_stop"), F.min("keep").alias("keep_id"))

    def real(name: str):
        return F.when(F.col(name) != _NO_ID, F.col(name)).alias(name)

    return merged.select(real("doc_id"), "first_word", (F.col("_stop") - F.col("first_word")).alias("n_words"), real("keep_id"), "kept")


def remove_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents of ``doc_id, text`` whose repeated passages that aren't kept are cut out of the text."""
    cut = passages.filter("not kept").groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "n_words")).alias("_cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                raw, offsets = raw_bytes(part.column("text"))
                starts, ends, before = word_spans(LOWER[raw], offsets, ALPHANUMERIC)
                texts = []
                for k, spans in enumerate(part.column("_cut").to_pylist()):
                    keep = np.ones(offsets[k + 1] - offsets[k], bool)
                    for s in spans or ():
                        a = before[k] + s["first_word"]
                        b = min(a + s["n_words"], before[k + 1])
                        if a < b:
                            keep[starts[a] - offsets[k] : ends[b - 1] - offsets[k]] = False
                    texts.append(raw[offsets[k] : offsets[k + 1]][keep].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    own = docs.select("doc_id", whole_text().alias("text"))
    return own.join(cut, "doc_id", "left").select("doc_id", "text", "_cut").mapInArrow(run, own.schema)
