"""Gradient boosting of all classes at once, from histograms of binned features.

Features are binned once, to a byte each, and stay with their task. A level of a round's trees is one exchange: every
task adds up first and second derivatives per node, feature and bin for all classes together, and the sums decide the
splits. Rows move never, and what comes back is as large as nodes x bins, not as the data. A table that fits one task
needs no exchange, so its task grows many rounds in one job; larger ones take a job per level, and every
``REFRESH`` rounds the tasks' running sums are written to the shared folder.

The losses are softmax over the classes, with its second derivatives, or squared error. Leaves are shrunk by
``l1`` and ``l2``; a split must gain ``min_gain``, leave ``min_rows`` rows and ``min_weight`` second derivatives
on both sides. Trees grow by levels, by leaves (best first, up to ``leaves``) or symmetrically; symmetric ones only
know ``min_gain``.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom.session import checkpointed, shared_dir

#: Bins of a numeric feature, rounds between writes of the tasks' sums, rounds of a one-task job.
BINS, REFRESH, SEGMENT = 255, 10, 1000


@dataclass(frozen=True)
class Settings:
    """What to grow. ``outputs`` is the number of classes, 1 for squared error."""

    outputs: int
    rounds: int = 100
    rate: float = 0.1
    depth: int = 6
    leaves: int | None = None
    symmetric: bool = False
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    min_rows: int = 1
    min_weight: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    #: Factor of the second derivatives of softmax: libraries differ in it.
    curvature: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order they were made. A row goes left where its bin is at most ``cut``, or listed in ``groups``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    group: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    groups: list[list[int]] = field(default_factory=list)

    def split(self, node: int, feature: int, cut: int, group: list[int] | None, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        if group is not None:
            self.group[node] = len(self.groups)
            self.groups.append(group)
        sides = (len(self.feature), len(self.feature) + 1)
        self.left[node], self.right[node] = sides
        for v in values:
            self.feature.append(-1), self.cut.append(0), self.group.append(-1), self.left.append(-1), self.right.append(-1)
            self.value.append(float(v)), self.gain.append(0.0)
        return sides

    def route(self, bins: np.ndarray, node: np.ndarray | None = None, steps: int | None = None) -> np.ndarray:
        """The node where each row ends, or is after ``steps``."""
        feature, cut, group = (np.array(x, np.int32) for x in (self.feature, self.cut, self.group))
        sides = np.array([self.right, self.left], np.int32)
        at = np.zeros(len(bins), np.int32) if node is None else node
        listed = None
        if self.groups:
            listed = np.zeros((len(self.groups), int(max(map(max, self.groups))) + 1), bool)
            for k, g in enumerate(self.groups):
                listed[k, g] = True
        rows = np.arange(len(bins))
        while steps is None or steps > 0:
            f = feature[at[rows]]
            rows = rows[f >= 0]
            if not len(rows):
                break
            own = at[rows]
            b = bins[rows, feature[own]]
            goes = b <= cut[own]
            if listed is not None:
                g = group[own]
                inside = listed[np.maximum(g, 0), np.minimum(b, listed.shape[1] - 1)] & (b < listed.shape[1])
                goes = np.where(g >= 0, inside, goes)
            at[rows] = sides[goes.astype(np.int8), own]
            steps = None if steps is None else steps - 1
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.route(bins)]


@dataclass
class Even:
    """A symmetric tree: one cut for all nodes of a level. A row's leaf has a bit per level, set where its bin is above the cut."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=lambda: [0.0])

    def route(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for k, (f, b) in enumerate(zip(self.feature, self.cut, strict=True)):
            at |= (bins[:, f] > b).astype(np.int64) << k
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.route(bins)]


@dataclass
class Binning:
    """Upper ends of the bins of each feature; a nominal feature (``None``) has its codes as bins."""

    ends: list[np.ndarray | None]
    sizes: list[int]

    def apply(self, x: np.ndarray) -> np.ndarray:
        kind = np.uint8 if max(self.sizes, default=1) <= 256 else np.uint16
        out = np.empty(x.shape, kind)
        for f, ends in enumerate(self.ends):
            out[:, f] = np.clip(x[:, f], 0, self.sizes[f] - 1) if ends is None else np.searchsorted(ends, x[:, f], side="left")
        return out

    @classmethod
    def fit(cls, rows: DataFrame, vector: Column, width: int, nominal: dict[int, int], bins: int = BINS) -> Binning:
        """Quantile bins from one sketch per feature; their ends lie midway between neighbouring values of two bins."""
        numeric = [f for f in range(width) if f not in nominal]
        ends: list[np.ndarray | None] = [None] * width
        sizes = [nominal.get(f, 1) for f in range(width)]
        if max(nominal.values(), default=0) > 65_536:
            raise ValueError(f"A nominal feature has {max(nominal.values())} values, 65,536 at most")
        if numeric:
            shares = [k / bins for k in range(1, bins + 1)]
            found = rows.agg(*[F.percentile_approx(vector[f], shares, 20 * bins).alias(f"q{f}") for f in numeric]).first()
            cuts = {f: np.unique(np.array(found[f"q{f}"] or [], float)) for f in numeric}

            def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                low, high = {}, {}
                for batch in batches:
                    x = _matrix(batch.column(0), width)
                    for f, c in cuts.items():
                        b = np.searchsorted(c, x[:, f], side="left")
                        lo, hi = low.setdefault(f, np.full(len(c) + 1, np.inf)), high.setdefault(f, np.full(len(c) + 1, -np.inf))
                        np.minimum.at(lo, b, x[:, f])
                        np.maximum.at(hi, b, x[:, f])
                for f in low:
                    some = np.flatnonzero(np.isfinite(low[f]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), f, np.int32)), pa.array(some.astype(np.int32)), pa.array(low[f][some]), pa.array(high[f][some])],
                        ["f", "b", "low", "high"])

            seen = rows.select(vector.alias("x")).mapInArrow(spans, "f int, b int, low double, high double")
            by_feature: dict[int, list] = {}
            for r in seen.groupBy("f", "b").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
                by_feature.setdefault(r["f"], []).append((r["b"], r["low"], r["high"]))
            for f in numeric:
                own = sorted(by_feature.get(f, []))
                ends[f] = np.array([(a[2] + b[1]) / 2 for a, b in zip(own, own[1:], strict=False)])
                sizes[f] = len(ends[f]) + 1
        return cls(ends, sizes)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


class Part:
    """The rows of one task, and what they add to an exchange."""

    def __init__(self, number: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, start: np.ndarray, plain: bool = False):
        self.number, self.bins, self.y, self.w, self.held = number, bins, y, w, held
        self.margin = np.tile(start.astype(float), (len(y), 1))
        # with squared error and no weights second derivatives are counts; all tasks must see it alike
        self.plain = plain
        self.own_columns: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("number", "bins", "y", "w", "held", "margin", "plain")} | {"own_columns": None}

    def begin(self, s: Settings, k: int) -> None:
        """Derivatives for round ``k``, of the rows drawn for it."""
        w = np.where(self.held, 0.0, self.w)
        drawn = ~self.held
        if s.row_share < 1:
            drawn = drawn & (np.random.default_rng((s.seed, k, self.number)).random(len(w)) < s.row_share)
            w = np.where(drawn, w, 0.0)
        if s.outputs == 1:
            self.g, self.h = (w * (self.margin[:, 0] - self.y))[None, :], w[None, :].astype(float)
        else:
            p = softmax(self.margin)
            own = np.zeros_like(p)
            own[np.arange(len(p)), self.y.astype(int)] = 1
            self.g, self.h = (w[:, None] * (p - own)).T, (w[:, None] * np.maximum(s.curvature * p * (1 - p), 1e-16)).T
        self.rows = np.flatnonzero(drawn)
        self.node = np.zeros((s.outputs, len(self.rows)), np.int32)
        if len(self.rows) < len(w):
            self.own_bins = self.bins[self.rows]
            self.own_columns = np.ascontiguousarray(self.own_bins.T)
        elif self.own_columns is None or self.own_columns.shape[1] < len(w):
            self.own_bins, self.own_columns = self.bins, np.ascontiguousarray(self.bins.T)
        self.leaf = [(0, np.zeros(len(self.rows), np.int64))] * s.outputs

    def leaves(self, c: int, tree: Even) -> np.ndarray:
        """The leaf of each drawn row, from the one it was in before the last cuts."""
        steps, at = self.leaf[c]
        for k in range(steps, len(tree.feature)):
            at = at + ((self.own_columns[tree.feature[k]] > tree.cut[k]).astype(np.int64) << k)
        self.leaf[c] = (len(tree.feature), at)
        return at

    def sums(self, trees: list[Tree], asked: list[list[int]], size: int) -> np.ndarray:
        """For each tree and asked node: first and second derivatives and rows, per feature and bin. The rows come last."""
        width = self.bins.shape[1]
        # second derivatives that are counts are sent once
        out = np.empty((2 if self.plain else 3, sum(map(len, asked)), width, size))
        begin = 0
        for c, nodes in enumerate(asked):
            if not nodes:
                continue
            if isinstance(trees[c], Even):
                at, bins, columns, rows = self.leaves(c, trees[c]) * size, self.own_bins, self.own_columns, self.rows
            else:
                self.node[c] = trees[c].route(self.own_bins, self.node[c])
                place = np.full(len(trees[c].feature), -1, np.int64)
                place[nodes] = np.arange(len(nodes))
                at = place[self.node[c]]
                some = np.flatnonzero(at >= 0)
                at, bins, columns, rows = at[some] * size, self.own_bins, self.own_columns, self.rows[some]
                if len(some) < len(self.rows):
                    bins = bins[some]
                    columns = bins.T
            g, h, cells = (self.g[c], self.h[c], len(nodes) * size) if len(rows) == len(self.y) else (self.g[c][rows], self.h[c][rows], len(nodes) * size)
            if bins.size <= 20_000:  # few rows: one call for all features costs less
                keys = (at[:, None] * width + (bins + np.arange(width, dtype=np.int64) * size)).ravel()
                cells *= width
                counts = np.bincount(keys, minlength=cells)
                second = [] if self.plain else [np.bincount(keys, np.repeat(h, width), cells)]
                for k, sums in enumerate((np.bincount(keys, np.repeat(g, width), cells), *second, counts)):
                    out[k, begin : begin + len(nodes)] = sums.reshape(len(nodes), width, size)
                begin += len(nodes)
                continue
            for f in range(width):
                keys = at + columns[f]
                counts = np.bincount(keys, minlength=cells)
                second = [] if self.plain else [np.bincount(keys, h, cells)]
                for k, sums in enumerate((np.bincount(keys, g, cells), *second, counts)):
                    out[k, begin : begin + len(nodes), f] = sums.reshape(len(nodes), size)
            begin += len(nodes)
        return out

    def add(self, trees: list[Tree]) -> None:
        for c, tree in enumerate(trees):
            known = isinstance(tree, Even) and self.own_columns is not None and self.own_columns.shape[1] == len(self.y)
            self.margin[:, c] += np.array(tree.value)[self.leaves(c, tree)] if known else tree.predict(self.bins)

    def loss(self) -> tuple[float, float]:
        """Summed loss of the rows held back, and how many they are."""
        m, y = self.margin[self.held], self.y[self.held]
        if self.margin.shape[1] == 1:
            return float(((m[:, 0] - y) ** 2).sum()), float(len(y))
        return float(-np.log(np.maximum(softmax(m)[np.arange(len(y)), y.astype(int)], 1e-300)).sum()), float(len(y))


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _shrunk(g: np.ndarray, s: Settings) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - s.l1, 0) if s.l1 else g


def _worth(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return _shrunk(g, s) ** 2 / (h + s.l2 + 1e-12)


@dataclass
class Choice:
    """The best split of a node."""

    gain: float
    feature: int = -1
    cut: int = -1
    group: list[int] | None = None
    values: tuple[float, float] = (0.0, 0.0)
    rows: tuple[float, float] = (0.0, 0.0)


class Chooser:
    """Decides splits from sums."""

    def __init__(self, s: Settings, binning: Binning):
        self.s, self.sizes = s, np.array(binning.sizes)
        self.nominal = np.array([e is None for e in binning.ends])
        self.size = int(self.sizes.max(initial=1))

    def columns(self, k: int) -> np.ndarray:
        """Features that round ``k`` may use."""
        n = len(self.sizes)
        if self.s.column_share >= 1:
            return np.ones(n, bool)
        take = max(1, round(n * self.s.column_share))
        out = np.zeros(n, bool)
        out[np.random.default_rng((self.s.seed, k, 1 << 20)).permutation(n)[:take]] = True
        return out

    def gains(self, sums: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Gain of every cut of every node and feature, the order of nominal bins, and sums left of each cut."""
        s, order = self.s, None
        if self.nominal.any():
            order = np.tile(np.arange(sums.shape[3]), (*sums.shape[1:3], 1))
            ratio = np.where(sums[-1] > 0, sums[0] / (sums[1] + s.l2 + 1e-12), np.inf)[:, self.nominal]
            order[:, self.nominal] = np.argsort(ratio, axis=2, kind="stable")
            sums = np.take_along_axis(sums, order[None], axis=3)
        left = np.cumsum(sums, axis=3)
        total = left[..., -1:]
        right = total - left
        gain = _worth(left[0], left[1], s) + _worth(right[0], right[1], s) - _worth(total[0], total[1], s)
        fits = (left[-1] >= s.min_rows) & (right[-1] >= s.min_rows) & (left[1] >= s.min_weight) & (right[1] >= s.min_weight)
        fits &= (left[-1] > 0) & (right[-1] > 0) & allowed[None, :, None]
        return np.where(fits, gain, -np.inf), order, left

    def best(self, sums: np.ndarray, allowed: np.ndarray) -> list[Choice]:
        """One choice per node."""
        gain, order, left = self.gains(sums, allowed)
        flat = gain.reshape(len(gain), -1)
        # of cuts that gain the same the first, whatever the order in which tasks were added up
        most = flat.max(axis=1)
        with np.errstate(invalid="ignore"):
            top = (flat >= (most - 1e-9 * (1 + np.abs(most)))[:, None]).argmax(axis=1)
        out = []
        for i, at in enumerate(top.tolist()):
            if not flat[i, at] > self.s.min_gain + 1e-10:
                out.append(Choice(-np.inf))
                continue
            f, b = divmod(at, gain.shape[2])
            group = order[i, f, : b + 1].tolist() if order is not None and self.nominal[f] else None
            one, other = left[:, i, f, b], left[:, i, f, -1] - left[:, i, f, b]
            out.append(Choice(float(flat[i, at]), f, b, group, self.values(one, other), (one[-1], other[-1])))
        return out

    def same(self, sums: np.ndarray, allowed: np.ndarray) -> tuple[int, int, float] | None:
        """The cut that gains most over all nodes together."""
        s = self.s
        sums = sums[:, sums[-1, :, 0].any(axis=1)]  # leaves without rows gain nothing
        left = np.cumsum(sums[:2], axis=3)
        total = left[..., -1:]
        right = total - left
        gain = (_worth(left[0], left[1], s) + _worth(right[0], right[1], s)).sum(axis=0)
        # a level has one cut, so a bound on the rows of a leaf can't hold in each of its leaves: as in the library it doesn't act
        gain = np.where(allowed[:, None], gain - _worth(total[0, :, :, 0], total[1, :, :, 0], s).sum(axis=0)[:, None], -np.inf)
        most = gain.max()
        f, b = divmod(int((gain >= most - 1e-9 * (1 + abs(most))).argmax()) if np.isfinite(most) else 0, gain.shape[1])
        return (f, b, float(gain[f, b])) if gain[f, b] > s.min_gain + 1e-10 else None

    def values(self, *sides: np.ndarray) -> tuple[float, ...]:
        return tuple(-self.s.rate * float(_shrunk(x[0], self.s) / (x[1] + self.s.l2 + 1e-12)) if x[1] > 0 else 0.0 for x in sides)


def _grow_even(s: Settings, chooser: Chooser, k: int, exchange: Callable) -> list[Even]:
    """Symmetric trees. The sums of the last level's cut also give the leaves, so the leaves cost no exchange."""
    trees = [Even() for _ in range(s.outputs)]
    allowed, going = chooser.columns(k), list(range(s.outputs)) if s.depth > 0 else []
    while going:
        sums, at = exchange(trees, [list(range(len(t.value))) if c in going else [] for c, t in enumerate(trees)]), 0
        for c in list(going):
            tree = trees[c]
            own = sums[:, at : at + len(tree.value)]
            at += len(tree.value)
            found = chooser.same(own, allowed)
            if found is None:
                going.remove(c)
                continue
            f, b, gain = found
            left = own[:2, :, f, : b + 1].sum(axis=2)
            right = own[:2, :, f, b + 1 :].sum(axis=2)
            g, h = np.concatenate([left, right], axis=1)
            tree.value = (-s.rate * _shrunk(g, s) / (h + s.l2 + 1e-12) * (h > 1e-12)).tolist()
            tree.feature.append(f), tree.cut.append(b), tree.gain.append(gain)
            if len(tree.feature) == s.depth:
                going.remove(c)
    return trees


def grow(s: Settings, chooser: Chooser, k: int, exchange: Callable[[list[Tree], list[list[int]]], np.ndarray]) -> list[Tree] | list[Even]:
    """The trees of a round. ``exchange`` gives the sums of the asked nodes of every tree."""
    if s.symmetric:
        return _grow_even(s, chooser, k, exchange)
    trees = [Tree() for _ in range(s.outputs)]
    level: list[dict[int, int]] = [{0: 0} for _ in trees]
    known: list[dict[int, Choice]] = [{} for _ in trees]
    kept: list[dict[int, np.ndarray]] = [{} for _ in trees]
    # of two sides only the smaller one is added up: (node, its parent and sibling)
    asked: list[list[tuple[int, int, int]]] = [[(0, -1, -1)] for _ in trees] if s.depth > 0 else [[] for _ in trees]
    allowed = chooser.columns(k)
    while any(asked):
        sums, at = exchange(trees, [[node for node, _, _ in own] for own in asked]), 0
        for c, own in enumerate(asked):
            if not own:
                continue
            found = {}
            for node, parent, sibling in own:
                found[node] = sums[:, at]
                at += 1
                if parent >= 0:
                    rest = kept[c].pop(parent) - found[node]
                    np.maximum(rest[1:], 0, out=rest[1:])  # what rounding left below
                    found[sibling] = np.where(rest[-1] > 0, rest, 0)
            kept[c].update(found)
            nodes = sorted(found)
            stacked = np.stack([found[n] for n in nodes], axis=1)
            if nodes == [0]:
                trees[c].value[0] = chooser.values(stacked[:, 0, 0].sum(axis=1))[0]
            known[c].update(zip(nodes, chooser.best(stacked, allowed), strict=True))
        asked = []
        for c, tree in enumerate(trees):
            fresh = []
            for node in wanted(tree, known[c], s.leaves):
                if tree.left[node] < 0:
                    choice = known[c][node]
                    sides = tree.split(node, choice.feature, choice.cut, choice.group, max(choice.gain, 0.0), choice.values)
                    level[c].update(dict.fromkeys(sides, level[c][node] + 1))
                    if level[c][node] + 1 < s.depth:
                        small = int(choice.rows[1] < choice.rows[0])
                        fresh.append((sides[small], node, sides[1 - small]))
            asked.append(fresh)
    if s.leaves is not None:
        trees = [pruned(tree, set(wanted(tree, known[c], s.leaves))) for c, tree in enumerate(trees)]
    return trees


def wanted(tree: Tree, known: dict[int, Choice], leaves: int | None) -> list[int]:
    """The nodes that splitting the most gaining leaf first, up to ``leaves``, would split as far as gains are known."""
    heap = [(-known[0].gain, 0)] if 0 in known else []
    out: list[int] = []
    while heap and (leaves is None or len(out) < leaves - 1):
        gain, node = heapq.heappop(heap)
        if known[node].feature < 0:
            continue
        out.append(node)
        for side in (tree.left[node], tree.right[node]):
            if side in known:
                heapq.heappush(heap, (-known[side].gain, side))
    return out


def pruned(tree: Tree, split: set[int]) -> Tree:
    """The tree with only these nodes split."""
    out = Tree(value=[tree.value[0]])
    todo = [(0, 0)]
    while todo:
        old, new = todo.pop()
        if old in split:
            group = tree.groups[tree.group[old]] if tree.group[old] >= 0 else None
            sides = out.split(new, tree.feature[old], tree.cut[old], group, tree.gain[old], (tree.value[tree.left[old]], tree.value[tree.right[old]]))
            todo += [(tree.left[old], sides[0]), (tree.right[old], sides[1])]
    return out


@dataclass
class Boosted:
    """A fitted model: starting margins and a list of trees per round."""

    settings: Settings
    binning: Binning
    start: np.ndarray
    rounds: list[list[Tree | Even]]
    losses: list[float]

    @property
    def trees(self) -> list[Tree]:
        return [t for r in self.rounds for t in r]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = self.binning.apply(x)
        out = np.tile(self.start.astype(float), (len(x), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += tree.predict(bins)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(x))

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        out = np.zeros(len(self.binning.sizes))
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    out[f] += gain
        return out / out.sum() if out.sum() else out

    def first(self, n: int) -> Boosted:
        return Boosted(self.settings, self.binning, self.start, self.rounds[:n], self.losses[:n])

    def to_state(self) -> dict:
        s = self.settings
        return {
            "settings": {f: getattr(s, f) for f in s.__dataclass_fields__}, "start": self.start.tolist(), "losses": self.losses,
            "ends": [None if e is None else e.tolist() for e in self.binning.ends], "sizes": list(map(int, self.binning.sizes)),
            "rounds": [[[getattr(t, f) for f in t.__dataclass_fields__] for t in r] for r in self.rounds],
        }

    @classmethod
    def from_state(cls, state: dict) -> Boosted:
        binning = Binning([None if e is None else np.array(e, float) for e in state["ends"]], state["sizes"])
        settings = Settings(**state["settings"])
        kind = Even if settings.symmetric else Tree
        return cls(settings, binning, np.array(state["start"]), [[kind(*t) for t in r] for r in state["rounds"]], state["losses"])


def predicted(model: Boosted, vector: Column) -> Column:
    """The number that a model of squared error gives for ``vector``; null for a null one."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        some = np.flatnonzero(x.notna())
        if len(some):
            out[some] = shared.value.margins(np.stack(x.iloc[some].to_list()))[:, 0]
        return pd.Series(out)

    return run(vector)


def starting_margins(s: Settings, weights: dict[int, float], mean: float) -> np.ndarray:
    """The mean, or the logarithms of the classes' shares."""
    if s.outputs == 1:
        return np.array([mean])
    total = sum(weights.values())
    return np.log([max(weights.get(c, 0.0), 1e-9) / total for c in range(s.outputs)])


def fit(
    rows: DataFrame, s: Settings, nominal: dict[int, int] | None = None, vector: str = "x", label: str = "y", weight: str | None = None, held: str | None = None,
    bins: int = BINS, binning: Binning | None = None, tasks: int = 1,
) -> Boosted:
    """Boost on ``vector`` (array of numbers without nulls) and ``label``; rows of ``held`` are only looked at.

    ``nominal`` names the features that are codes, with their number. ``tasks`` is what the rows are joined into: one
    for a small table, as with more than one every level is a job.
    """
    data = rows.select(
        F.col(vector).alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        (F.col(held) if held else F.lit(False)).alias("held")).coalesce(tasks)
    known = data.filter("not held")
    if binning is None:
        first = known.select(F.size("x")).first()
        if first is None:
            raise ValueError("There are no rows to learn from")
        binning = Binning.fit(known, F.col("x"), first[0], nominal or {}, bins)
    width = len(binning.sizes)

    def gathered(batches: Iterator[pa.RecordBatch], start: np.ndarray | None) -> Part | None:
        from pyspark import TaskContext

        xs, ys, ws, hs = [], [], [], []
        for batch in batches:
            if batch.num_rows:
                xs.append(binning.apply(_matrix(batch.column(0), width)))
                ys.append(batch.column(1).to_numpy()), ws.append(batch.column(2).to_numpy()), hs.append(batch.column(3).to_numpy(zero_copy_only=False))
        if not xs:
            return None
        y, w, held = np.concatenate(ys), np.concatenate(ws), np.concatenate(hs).astype(bool)
        if start is None:
            sums = np.bincount(y[~held].astype(int), w[~held]) if s.outputs > 1 else []
            start = starting_margins(s, dict(enumerate(sums)), float(np.average(y[~held], weights=w[~held])))
        return Part(TaskContext.get().partitionId(), np.concatenate(xs), y, w, held, start, s.outputs == 1 and weight is None)

    chooser = Chooser(s, binning)
    model = Boosted(s, binning, np.zeros(s.outputs), [], [])
    if tasks == 1:
        return _in_one_task(data, gathered, model, chooser)
    # a literal would count as the position of a column
    sums = known.groupBy(*["y"] if s.outputs > 1 else []).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).collect()
    total = sum(r["w"] for r in sums)
    model.start = start = starting_margins(s, {int(r["y"]): r["w"] for r in sums} if s.outputs > 1 else {}, sum(r["wy"] for r in sums) / total)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gathered(batches, start)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own, 5)], pa.large_binary())], ["part"])

    # one row per task, and everything that follows reads these
    return _level_by_level(checkpointed(data.mapInArrow(part, "part binary")), model, chooser)


def _rounds(part: Part, s: Settings, chooser: Chooser, begin: int, end: int) -> tuple[list[list[Tree]], list[float]]:
    grown, losses = [], []
    for k in range(begin, end):
        part.begin(s, k)
        trees = grow(s, chooser, k, lambda trees, asked: part.sums(trees, asked, chooser.size))
        part.add(trees)
        grown.append(trees)
        if part.held.any():
            total, n = part.loss()
            losses.append(total / n)
    return grown, losses


def _in_one_task(data: DataFrame, gathered: Callable, model: Boosted, chooser: Chooser) -> Boosted:
    """``SEGMENT`` rounds per job: a lost executor costs no more than these."""
    s, parts = model.settings, None
    while len(model.rounds) < s.rounds:
        begin, end = len(model.rounds), min(s.rounds, len(model.rounds) + SEGMENT)

        def segment(batches: Iterator[pa.RecordBatch], begin=begin, end=end) -> Iterator[pa.RecordBatch]:
            if begin == 0:
                part = gathered(batches, None)
                held = [] if part is None else [part]
            else:
                held = [pickle.loads(blob) for batch in batches for blob in batch.column(0).to_pylist()]
            for part in held:
                found = part.margin[0].copy(), *_rounds(part, s, chooser, begin, end)
                more = pickle.dumps(part, 5) if end < s.rounds else b""
                yield pa.RecordBatch.from_arrays([pa.array([more], pa.large_binary()), pa.array([pickle.dumps(found, 5)], pa.large_binary())], ["part", "found"])

        done = (data if parts is None else parts).mapInArrow(segment, "part binary, found binary")
        done = checkpointed(done) if end < s.rounds else done
        found = done.select("found").collect()
        if not found:
            raise ValueError("There are no rows to learn from")
        start, rounds, losses = pickle.loads(found[0][0])
        if begin == 0:
            model.start = start.copy()
        model.rounds += rounds
        model.losses += losses
        parts = done.select("part")
    return model


def _level_by_level(parts: DataFrame, model: Boosted, chooser: Chooser) -> Boosted:
    """A job per level; every ``REFRESH`` rounds the margins are brought up to date and written."""
    s = model.settings
    rdd = parts.rdd.map(lambda r: bytes(r[0]))
    shared_dir(parts.sparkSession)
    since: list[list[Tree]] = []

    def caught_up(blob: bytes, since: list[list[Tree]]) -> Part:
        part = pickle.loads(blob)
        for trees in since:
            part.add(trees)
        return part

    for k in range(s.rounds):
        def exchange(trees: list[Tree], asked: list[list[int]], k=k) -> np.ndarray:
            past, size = list(since), chooser.size

            def sums(blob: bytes) -> np.ndarray:
                part = caught_up(blob, past)
                part.begin(s, k)
                return part.sums(trees, asked, size)

            return rdd.map(sums).treeReduce(lambda a, b: a + b)

        since.append(grow(s, chooser, k, exchange))
        model.rounds.append(since[-1])
        if len(since) == REFRESH or k == s.rounds - 1:
            past = list(since)

            def renewed(blob: bytes) -> tuple[bytes, list[tuple[float, float]]]:
                part, losses = pickle.loads(blob), []
                for trees in past:
                    part.add(trees)
                    losses.append(part.loss())
                return pickle.dumps(part, 5), losses

            both = rdd.map(renewed)
            both.checkpoint()
            summed = np.sum(np.array(both.map(lambda x: x[1]).collect()), axis=0)
            model.losses += [float(a / n) for a, n in summed if n]
            rdd, since = both.map(lambda x: x[0]), []
    return model
