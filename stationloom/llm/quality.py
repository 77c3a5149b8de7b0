"""A quality classifier: a small byte-level convolutional network, trained and run in numpy.

Learned filters of ``WIDTH`` bytes run over every position of the whole text. Their outputs are
max-pooled in chunks of two blocks that overlap by one, every chunk passes a small hidden layer, and
the largest and the mean activation over all chunks are combined into one probability. The cost is
linear in the bytes, and memory is bounded by the slice that is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.llm.samples import labelled_sample
from stationloom.llm.text import raw_bytes, text_slices, whole_text

BLOCK, WIDTH, FILTERS, EMBEDDED, HIDDEN = 128, 8, 16, 8, 16
#: The training sample: so many labelled documents of each class, and bytes in all, at most.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1500, 16 << 20
EPOCHS, RATE, DECAY, SEED = 14, 0.01, 1e-4, 7
THRESHOLD = 0.3


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of ``BLOCK`` bytes and the ``WIDTH - 1`` that follow in the text, each text filled up with
    zeros (an empty one is a block of zeros), and the number of rows before each text."""
    sizes = np.diff(offsets)
    rows = np.maximum(1, -(-sizes // BLOCK))
    before = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(rows, out=before[1:])
    out = np.zeros(int(before[-1]) * BLOCK, np.uint8)
    out[np.arange(len(data)) + np.repeat(before[:-1] * BLOCK - offsets[:-1], sizes)] = data
    out = out.reshape(-1, BLOCK)
    after = np.zeros((len(out), WIDTH - 1), np.uint8)
    after[:-1] = out[1:, : WIDTH - 1]
    after[before[1:] - 1] = 0
    return np.hstack([out, after]), before


@dataclass
class ByteNet:
    """The weights, and what they compute."""

    embedding: np.ndarray
    filters: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> ByteNet:
        def draw(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        embedding = rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDED), (WIDTH, EMBEDDED, FILTERS)).astype(np.float32)
        return cls(embedding, filters, draw(FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), np.append(draw(2 * HIDDEN), [0]).astype(np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.hidden, self.hidden_bias, self.out]

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each place: place, byte, filter."""
        return np.ascontiguousarray(np.einsum("be,wef->wbf", self.embedding, self.filters))

    def pooled(self, rows: np.ndarray, positions: bool = False):
        """The largest output of each filter in each block, and where it starts.

        A filter that starts at the end of a block reads on into the bytes that follow in the text, or zeros behind
        its end, so every position counts and a text never depends on its neighbour.
        """
        tables, last = self.tables(), BLOCK
        best = np.empty((len(rows), FILTERS), np.float32)
        where = np.empty((len(rows), FILTERS), np.int64) if positions else None
        for a in range(0, len(rows), 256):
            own = rows[a : a + 256]
            total = np.take(tables[0], own[:, :last], axis=0)
            for k in range(1, WIDTH):
                total += np.take(tables[k], own[:, k : k + last], axis=0)
            if positions:
                where[a : a + 256] = total.argmax(axis=1)
            best[a : a + 256] = total.max(axis=1)
        return best, where

    def chunks(self, best: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two neighbouring blocks of a text make a chunk; the last block pairs with itself."""
        mate = np.arange(1, len(best) + 1)
        mate[before[1:] - 1] -= 1
        return np.maximum(best, best[mate]), mate

    def logits(self, rows: np.ndarray, before: np.ndarray) -> np.ndarray:
        pooled, _ = self.chunks(self.pooled(rows)[0], before)
        act = np.maximum(np.maximum(pooled, 0) @ self.hidden + self.hidden_bias, 0)
        counts = np.diff(before)[:, None]
        features = np.hstack([np.maximum.reduceat(act, before[:-1]), np.add.reduceat(act, before[:-1]) / counts])
        return features @ self.out[:-1] + self.out[-1] + self.shift

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, before = blocks_of(*raw_bytes(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, before).astype(np.float64), -40, 40)))

    def gradients(self, rows: np.ndarray, before: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n = len(labels)
        best, where = self.pooled(rows, positions=True)
        pooled, mate = self.chunks(best, before)
        source = np.where(best >= best[mate], np.arange(len(best))[:, None], mate[:, None])
        lit = np.maximum(pooled, 0)
        act = np.maximum(lit @ self.hidden + self.hidden_bias, 0)
        counts = np.diff(before)
        text = np.repeat(np.arange(n), counts)
        top = np.maximum.reduceat(act, before[:-1])
        mean = np.add.reduceat(act, before[:-1]) / counts[:, None]
        features = np.hstack([top, mean, np.ones((n, 1), np.float32)])
        d_logit = ((1 / (1 + np.exp(-features @ self.out)) - labels) / n).astype(np.float32)
        d_out = features.T @ d_logit
        d_act = (d_logit / counts)[text, None] * self.out[HIDDEN : 2 * HIDDEN]
        is_top = act == top[text]
        share = np.add.reduceat(is_top.astype(np.float32), before[:-1])
        d_act += is_top * (d_logit[text, None] * self.out[:HIDDEN] / share[text])
        d_act[act <= 0] = 0
        d_hidden, d_bias = lit.T @ d_act, d_act.sum(axis=0)
        d_pooled = d_act @ self.hidden.T
        d_pooled[pooled <= 0] = 0
        chunk, f = np.nonzero(d_pooled)
        g = d_pooled[chunk, f]
        row = source[chunk, f]
        at = row * rows.shape[1] + where[row, f]
        flat, d_tables = rows.ravel(), np.empty((WIDTH, 256, FILTERS), np.float32)
        for k in range(WIDTH):
            d_tables[k] = np.bincount(flat[at + k].astype(np.int64) * FILTERS + f, g, 256 * FILTERS).reshape(256, FILTERS)
        d_embedding = np.einsum("wbf,wef->be", d_tables, self.filters)
        d_filters = np.einsum("wbf,be->wef", d_tables, self.embedding)
        return [d_embedding, d_filters, d_hidden, d_bias, d_out]


def train(texts: list[str], labels: np.ndarray, log_odds: float, epochs: int = EPOCHS) -> ByteNet:
    """Fit a network to labelled texts by Adam, classes weighing the same; ``log_odds`` of label 1
    in the whole table then shifts the scores back to probabilities."""
    rng = np.random.default_rng(SEED)
    net = ByteNet.fresh(rng)
    labels = np.asarray(labels, np.float32)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        net.out[:] = 0
        net.shift = float(log_odds)
        return net
    size = max(len(good), len(bad))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step, batches = 0, max(8, 2 * size // 64)
    for epoch in range(epochs):
        order = np.stack([rng.permutation(np.resize(rng.permutation(x), size)) for x in (good, bad)], axis=1).ravel()
        for own in np.array_split(order, batches):
            data, offsets = raw_bytes(pa.array([texts[k] for k in own]))
            rows, before = blocks_of(data, offsets)
            step += 1
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for w, g, (m, v) in zip(net.weights(), net.gradients(rows, before, labels[own]), moments, strict=True):
                g = g + DECAY * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.shift = float(log_odds)
    return net


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is never learnt from: crc32 of the id as text leaves no remainder by 5. A null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> ByteNet:
    """Train on a bounded sample of the labelled documents that aren't held out.

    See ``samples.labelled_sample``: ``per_class`` documents of each label and ``sample_bytes`` of text at most.
    """
    sample = labelled_sample(docs, labels, "quality", is_held_out(F.col("doc_id")), {0: per_class, 1: per_class}, sample_bytes)
    return train(sample.texts, sample.labels, sample.log_odds)


def quality_scores(docs: DataFrame, net: ByteNet, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; null texts are empty and scored too.

    Repeated rows each give a row, an empty table none; other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                score = shared.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: ByteNet, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield part.filter(pa.array(shared.value.scores(part.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
