"""Regression forests of unlimited depth on a table that fits one task.

Trees are what is spread out: every task grows some of them, on all rows. The rows are broadcast, binned to a byte per
feature, and their number is checked first (``MOST_ROWS``); larger tables take Spark's own forest. A task grows one
tree at a time, level by level, on rows kept in order of (node, bin), so its memory follows the rows and not the nodes.

Trees are as large as the rows, and a chain has many forests, so no tree reaches the driver: tasks write theirs to the shared
folder, and tasks read them from there, tree by tree, to answer for blocks of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom.operators.boosting import Binning, Boosted, _matrix
from stationloom.session import scratch_path

#: Rows of a broadcast table, at most, and tasks per core that trees are dealt to.
MOST_ROWS, TASKS_A_CORE = 100_000, 4


@dataclass
class Grown:
    """Nodes level by level, -1 for a leaf: of the k-th node that is split the sides are nodes 2k + 1 and 2k + 2.

    A row goes left where its bin is at most ``cut``; ``value`` has the leaves, ``gain`` the sum of all splits by a feature.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        split = self.feature >= 0
        left, leaf = 2 * np.cumsum(split) - 1, np.cumsum(~split) - 1
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[split[at[rows]]]):
            own = at[rows]
            at[rows] = left[own] + (bins[rows, self.feature[own]] > self.cut[own])
        return self.value[leaf[at]]


def _cuts(columns: np.ndarray, order: np.ndarray, w: np.ndarray, wy: np.ndarray, start: np.ndarray, node: np.ndarray, min_rows: int) -> tuple[np.ndarray, ...]:
    """Per node its best gain, the feature, the last place on the left, and weights and sums of both sides.

    ``order`` has for each feature the rows of all nodes, one node behind the other, in order of its bins.
    """
    inner = node[1:] == node[:-1]
    total_w, total_y = np.add.reduceat(w[order[0]], start), np.add.reduceat(wy[order[0]], start)
    best, feature, at = np.full(len(start), -np.inf), np.full(len(start), -1), np.zeros(len(start), np.int64)
    sums = np.zeros((2, len(start)))
    for f, own in enumerate(order):
        b, own_w, own_y = columns[f][own], w[own], wy[own]
        ends = np.flatnonzero(inner & (b[1:] != b[:-1]))
        if not len(ends):
            continue
        of = node[ends]
        cw, cy = np.cumsum(own_w), np.cumsum(own_y)
        lw, ly = cw[ends] - (cw[start] - own_w[start])[of], cy[ends] - (cy[start] - own_y[start])[of]
        rw, ry = total_w[of] - lw, total_y[of] - ly
        gain = ly * ly / lw + ry * ry / rw
        if min_rows > 1:
            gain[(lw < min_rows) | (rw < min_rows)] = -np.inf
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        top, of = np.maximum.reduceat(gain, begin), of[begin]
        better = np.flatnonzero(top > best[of])
        # of cuts that gain the same the first
        hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(begin, len(gain)))))
        first, of = hits[np.searchsorted(hits, begin[better])], of[better]
        best[of], feature[of], at[of], sums[:, of] = top[better], f, ends[first], (lw[first], ly[first])
    parent = total_y**2 / total_w
    # rounding must not split a node whose rows are all alike
    return best - parent - 1e-9 * (1 + parent), feature, at, sums, np.stack([total_w, total_y]) - sums


def _grow_tree(bins: np.ndarray, y: np.ndarray, number: int, depth: int, min_rows: int, seed: int) -> Grown:
    n, width = bins.shape
    weight = np.bincount(np.random.default_rng((seed, number)).integers(0, n, n), minlength=n)
    row = np.flatnonzero(weight)
    w = weight[row].astype(float)
    wy = w * y[row]
    columns = np.ascontiguousarray(bins[row].T)
    order = np.argsort(columns, axis=1, kind="stable")
    start, count, home = np.zeros(1, np.int64), np.array([len(row)]), np.zeros(1, np.int64)
    features, cuts, values = [np.full(1, -1, np.int16)], [np.zeros(1, bins.dtype)], [np.array([wy.sum() / w.sum()])]
    gains = np.zeros(width)
    for _ in range(depth if len(row) > 1 else 0):
        node = np.repeat(np.arange(len(start)), count)
        gain, feature, at, left, right = _cuts(columns, order, w, wy, start, node, min_rows)
        split = np.flatnonzero(gain > 1e-9)
        if not len(split):
            break
        gains += np.bincount(feature[split], gain[split], width)
        cut = columns[feature, order[feature, at]]
        features[-1][home[split]], cuts[-1][home[split]] = feature[split], cut[split]
        # two sides follow for each node that is split; those of a single row stay leaves
        sides, both = 2 * len(split), np.stack([left[:, split], right[:, split]], axis=2).reshape(2, -1)
        features.append(np.full(sides, -1, np.int16)), cuts.append(np.zeros(sides, bins.dtype)), values.append(both[1] / both[0])
        rows = (at - start + 1)[split]
        rows = np.stack([rows, count[split] - rows], axis=1).ravel()
        home = np.flatnonzero((rows > 1) & (both[0] >= 2 * min_rows))
        place = np.full(sides + 2, -1)
        place[home] = np.arange(len(home))
        first = np.full(len(start), sides)
        first[split] = np.arange(0, sides, 2)
        own = order[0]
        slot = np.full(len(row), -1)
        slot[own] = place[first[node] + (columns[feature[node], own] > cut[node])]
        # numbers of two bytes are sorted in linear time
        slot = slot.astype(np.int16 if len(home) < 32_768 else np.int64)
        kept = []
        for own in order:
            now = slot[own]
            inside = now >= 0
            kept.append(own[inside][np.argsort(now[inside], kind="stable")])
        order, count = np.stack(kept), rows[home]
        start = np.cumsum(count) - count
        if not len(home):
            break
    feature, cut, value = np.concatenate(features), np.concatenate(cuts), np.concatenate(values)
    return Grown(feature.astype(np.int8) if width < 128 else feature, cut, value[feature < 0], gains)


def grow_forest(bins: np.ndarray, y: np.ndarray, numbers: np.ndarray, size: int, depth: int, min_rows: int, seed: int) -> list[Grown]:
    """Trees on bootstrap samples; the one of each number is drawn by it alone."""
    return [_grow_tree(bins, y, int(k), depth, min_rows, seed) for k in numbers]


@dataclass
class Forest:
    """The mean of trees that lie in the shared folder, a row for each."""

    binning: Binning
    path: str
    count: int

    def table(self) -> DataFrame:
        """The trees as ``k``, ``tree``."""
        return SparkSession.active().read.schema("k long, tree binary").parquet(self.path)

    @property
    def trees(self) -> Iterator[Grown]:
        """The trees in order, part by part."""
        return (pickle.loads(r["tree"]) for r in self.table().orderBy("k").toLocalIterator())

    def margins(self, x: np.ndarray) -> np.ndarray:
        """What the forest gives for a few rows."""
        bins = self.binning.apply(x)
        return sum((t.predict(bins) for t in self.trees), np.zeros(len(x)))[:, None] / max(1, self.count)

    def copied(self, path: str) -> Forest:
        """The same forest, its trees written elsewhere."""
        self.table().write.parquet(path)
        return Forest(self.binning, path, self.count)

    def to_state(self) -> dict:
        """Where the trees are, and what else is needed to use them."""
        return {"ends": [e.tolist() for e in self.binning.ends], "sizes": list(map(int, self.binning.sizes)), "path": self.path, "count": self.count}

    @classmethod
    def from_state(cls, state: dict) -> Forest:
        return cls(Binning([np.array(e, float) for e in state["ends"]], state["sizes"]), state["path"], state["count"])


class Gathered(Boosted):
    """A forest whose trees are in its state, as they were stored before they had a folder."""

    def margins(self, x: np.ndarray) -> np.ndarray:
        return super().margins(x) / max(1, len(self.rounds))


def fit_forest(rows: DataFrame, vector: str, label: str, binning: Binning, trees: int = 100, depth: int = 10_000, min_rows: int = 1, seed: int = 42) -> Forest:
    """A forest on ``vector`` (array of numbers without nulls) and ``label`` of at most ``MOST_ROWS`` rows."""
    table = gathered(rows.select(F.col(vector).alias("x"), F.col(label).cast("double").alias("y")))
    x = _matrix(table.column("x").combine_chunks(), len(binning.sizes))
    return plant(rows.sparkSession, x, table.column("y").to_numpy(), x[:0], binning, trees, depth, min_rows, seed)[0]


def gathered(rows: DataFrame) -> pa.Table:
    """At most ``MOST_ROWS`` rows."""
    table = rows.limit(MOST_ROWS + 1).toArrow().combine_chunks()
    if table.num_rows > MOST_ROWS:
        raise ValueError(f"Over {MOST_ROWS:,} rows are more than one task grows a forest on")
    return table


def plant(
    spark: SparkSession, x: np.ndarray, y: np.ndarray, asked: np.ndarray, binning: Binning, trees: int, depth: int, min_rows: int, seed: int
) -> tuple[Forest, np.ndarray]:
    """A forest on ``x`` and ``y``, and what it gives for the rows of ``asked``, which each tree answers where it is grown."""
    order = np.lexsort((y, *x.T))  # bootstrap samples don't depend on how rows came
    shared = spark.sparkContext.broadcast((binning.apply(x[order]), y[order], binning.apply(asked)))
    size = max(binning.sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, asked = shared.value
        for batch in batches:
            for k in batch.column(0).to_numpy():
                tree, = grow_forest(bins, y, [k], size, depth, min_rows, seed)
                blobs = [pa.array([b], pa.large_binary()) for b in (pickle.dumps(tree, 5), tree.predict(asked).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([k]), *blobs], ["k", "tree", "given"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value[2]))
        for batch in batches:
            for given in batch.column(1):
                total += np.frombuffer(given.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary())], ["total"])

    path = scratch_path(spark, "forest")
    tasks = min(trees, TASKS_A_CORE * max(1, spark.sparkContext.defaultParallelism))
    spark.range(0, trees, 1, tasks).mapInArrow(run, "k long, tree binary, given binary").write.option("compression", "zstd").parquet(path)
    given = np.zeros(len(asked))
    if len(asked):
        answers = spark.read.schema("k long, given binary").parquet(path).coalesce(1).sortWithinPartitions("k")
        given = np.frombuffer(answers.mapInArrow(added, "total binary").first()["total"]) / trees
    shared.destroy()
    return Forest(binning, path, trees), given
