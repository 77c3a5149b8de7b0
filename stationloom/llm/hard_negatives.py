"""Hard negatives by angular triangle filtering.

Every row's angles to a few reference directions are computed once and stored beside it. For an anchor and a
row they give an interval for the angle between the two (triangle inequality on the sphere), and with the norms
bounds of their inner product, widened by more than rounding can cost. An exact integer score is computed only
where these bounds reach into a window that is still open: above the last of an anchor's best positives so far,
or inside the window of one of its positives and above the last of its best negatives so far.

Anchors are a stated query set. They go through in blocks of bounded size, and each block meets all rows where
they lie: rows are never shuffled, only the best of each task are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom.session import checkpointed, scratch_path

#: Reference directions, the rows they are chosen from, and the anchors that go through together.
REFERENCES, REFERENCE_SAMPLE, ANCHORS = 8, 4096, 4096
POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Hundredths of a positive's score between which a negative's must lie.
LOW, HIGH = 30, 90
#: Rows and anchors whose bounds are looked at together; rows of a block that is discarded as one.
ROW_TILE, ANCHOR_TILE, BLOCK = 1024, 256, 64
#: What is added to angles (radians) and to bounds (relative to the norms) for rounding.
ANGLE_SLACK, NORM_SLACK = np.float32(1e-5), 1e-6
_NONE = np.iinfo(np.int64).min


@dataclass
class Vectors:
    """Rows of one number of components: whole numbers as doubles, with norms and angles to the references."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.values[at], self.norms[at], self.angles[at])


def angles_to(values: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to unit vectors; a zero vector, whose scores are zero anyway, has right angles."""
    cosines = (values / np.where(norms > 0, norms, 1)[:, None]) @ references.T
    return np.arccos(np.clip(cosines, -1, 1))


def choose_references(values: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors among ``values`` that are far from each other: each next one has the largest angle to those before."""
    norms = np.linalg.norm(values, axis=1)
    units = values[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.empty((0, values.shape[1]))
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def _widest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest difference of any coordinate, for every pair of rows."""
    out, gap = np.zeros((len(a), len(b)), np.float32), np.empty((len(a), len(b)), np.float32)
    for r in range(a.shape[1]):
        np.subtract(a[:, r, None], b[None, :, r], out=gap)
        np.abs(gap, out=gap)
        np.maximum(out, gap, out=out)
    return out


def _product(anchors: Vectors, rows: Vectors, angle: np.ndarray, slack: int) -> np.ndarray:
    """Norms times the cosine, with what rounding can cost added or taken off."""
    norms = (anchors.norms[:, None] * rows.norms[None, :]).astype(np.float32)
    return norms * np.cos(angle) + np.float32(slack) * (norms * np.float32(NORM_SLACK) + 1)


def score_ceiling(anchors: Vectors, rows: Vectors) -> np.ndarray:
    """What the inner product of an anchor with a row is at most: their angle isn't below any difference of angles."""
    least = _widest(anchors.angles.astype(np.float32), rows.angles.astype(np.float32))
    return _product(anchors, rows, np.maximum(least - ANGLE_SLACK, 0), 1)


def score_floor(anchors: Vectors, rows: Vectors) -> np.ndarray:
    """And at least: their angle isn't above any sum of angles, nor above what is left of a full turn."""
    spread = _widest(anchors.angles.astype(np.float32), (np.pi - rows.angles).astype(np.float32))
    return _product(anchors, rows, np.minimum(np.float32(np.pi) - spread + ANGLE_SLACK, np.float32(np.pi)), -1)


def block_ceiling(anchors: Vectors, rows: Vectors, block: int = BLOCK) -> np.ndarray:
    """The largest score any row of each block of neighbouring rows can have with each anchor."""
    first = np.arange(0, len(rows), block)
    near, far = np.minimum.reduceat(rows.angles, first, axis=0), np.maximum.reduceat(rows.angles, first, axis=0)
    least = np.zeros((len(anchors), len(first)))
    for r in range(anchors.angles.shape[1]):
        a = anchors.angles[:, r, None]
        np.maximum(least, np.maximum(a - far[None, :, r], near[None, :, r] - a), out=least)
    cosine = np.cos(np.maximum(least - ANGLE_SLACK, 0))
    small, large = np.minimum.reduceat(rows.norms, first), np.maximum.reduceat(rows.norms, first)
    norm = anchors.norms[:, None] * np.where(cosine > 0, large[None, :], small[None, :])
    return norm * cosine + np.abs(norm) * NORM_SLACK + 1


def exact_scores(anchors: Vectors, rows: Vectors, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer inner products of the pairs in ``may``, with the places of both.

    Few pairs are computed one by one, many as a product of the rows and anchors that have any. Beyond what doubles
    hold exactly Python's integers are used, and beyond a long a score is cut off at its ends.
    """
    a, b = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    left, right = anchors.values[a], rows.values[b]
    if not len(a):
        return a, b, np.empty(0, np.int64)
    may = may[a][:, b]
    i, j = np.nonzero(may)
    if left.shape[1] * np.abs(left).max(initial=0) * np.abs(right).max(initial=0) < 2.0**53:
        score = (left @ right.T)[may] if 8 * len(i) > may.size else np.einsum("ij,ij->i", left[i], right[j])
        return a[i], b[j], score.astype(np.int64)
    ends = np.iinfo(np.int64)
    whole_left, whole_right = ([[int(x) for x in v] for v in side] for side in (left, right))
    score = [min(max(sum(x * y for x, y in zip(whole_left[k], whole_right[m], strict=True)), ends.min), ends.max) for k, m in zip(i.tolist(), j.tolist(), strict=True)]
    return a[i], b[j], np.array(score, np.int64)


class Best:
    """The best rows of each group (an anchor, or an anchor's positive): higher scores first, ties by smaller id.

    ``floor`` is a score that the last of a group's best reaches at least. New rows wait until there are enough of
    them to be sorted in.
    """

    def __init__(self, groups: int, keep: int, floor: np.ndarray | None = None):
        self.keep = keep
        self.floor = np.full(groups, _NONE) if floor is None else floor.copy()
        self.waiting = [tuple(np.empty(0, np.int64) for _ in range(3))]
        self.kept = self.new = 0

    def add(self, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        good = score >= self.floor[group]
        if good.any():
            self.waiting.append((group[good], score[good], row[good]))
            self.new += len(self.waiting[-1][0])
            if self.new > max(8192, self.kept // 2):
                self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, score and id of the best so far."""
        group, score, row = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        order = np.lexsort((row, -score, group))
        group, score, row = group[order], score[order], row[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        best, last = place < self.keep, place == self.keep - 1
        self.floor[group[last]] = np.maximum(self.floor[group[last]], score[last])
        self.waiting = [(group[best], score[best], row[best])]
        self.kept, self.new = int(best.sum()), 0
        return self.waiting[0]


@dataclass
class Counted:
    """Pairs that might matter by label, and those that were scored."""

    pairs: int = 0
    scored: int = 0


def tiles(anchors: Vectors, rows: Vectors) -> Iterator[tuple[np.ndarray, Vectors, Vectors]]:
    """Parts of both, with the places of the anchors."""
    places = np.arange(len(anchors))
    for i in range(0, len(rows), ROW_TILE):
        part = rows.take(slice(i, i + ROW_TILE))
        for k in range(0, len(anchors), ANCHOR_TILE):
            at = places[k : k + ANCHOR_TILE]
            yield at, anchors.take(at), part


def find_positives(anchors: Vectors, rows: Vectors, best: Best, counted: Counted | None = None) -> None:
    """Offer every row of an anchor's label, but those with its own id, to ``best`` (a group per anchor)."""
    for label in np.unique(anchors.labels):
        places = np.flatnonzero(anchors.labels == label)
        for at, own, part in tiles(anchors.take(places), rows.take(np.flatnonzero(rows.labels == label))):
            group = places[at]
            may = own.ids[:, None] != part.ids[None, :]
            floor = best.floor[group][:, None]
            if counted:
                counted.pairs += int(may.sum())
            may &= np.repeat(block_ceiling(own, part) >= floor, BLOCK, axis=1)[:, : len(part)]
            some = np.flatnonzero(may.any(axis=0))
            part, may = part.take(some), may[:, some]
            may &= score_ceiling(own, part) >= floor
            a, b, score = exact_scores(own, part, may)
            if counted:
                counted.scored += len(a)
            best.add(group[a], score, part.ids[b])


@dataclass
class Windows:
    """For every positive: its anchor's place and the scores, both included, between which negatives lie."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, anchor: np.ndarray, score: np.ndarray) -> Windows:
        # LOW * p <= 100 * s <= HIGH * p, in Python's integers as p can be any long
        low = [-(-LOW * p // 100) for p in score.tolist()]
        high = [HIGH * p // 100 for p in score.tolist()]
        return cls(anchor, np.array(low, np.int64), np.array(high, np.int64))


def find_negatives(anchors: Vectors, rows: Vectors, windows: Windows, best: Best, counted: Counted | None = None) -> None:
    """Offer every row of another label whose score lies in a window to ``best`` (a group per window).

    ``windows`` are sorted by anchor.
    """
    for at, own, part in tiles(anchors, rows):
        first, last = np.searchsorted(windows.anchor, [at[0], at[-1] + 1])
        if first == last:
            continue
        anchor, low, high = windows.anchor[first:last] - at[0], windows.low[first:last], windows.high[first:last]
        floor = np.maximum(low, best.floor[first:last])
        still = np.flatnonzero(floor <= high)
        # of an anchor's open windows together: the lowest floor and the highest end
        least, most = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), _NONE)
        np.minimum.at(least, anchor[still], floor[still])
        np.maximum.at(most, anchor[still], high[still])
        may = own.labels[:, None] != part.labels[None, :]
        if counted:
            counted.pairs += int(may.sum())
        may &= (most >= least)[:, None]
        may &= np.repeat(block_ceiling(own, part) >= least[:, None], BLOCK, axis=1)[:, : len(part)]
        some = np.flatnonzero(may.any(axis=0))
        part, may = part.take(some), may[:, some]
        may &= (score_ceiling(own, part) >= least[:, None]) & (score_floor(own, part) <= most[:, None])
        a, b, score = exact_scores(own, part, may)
        if counted:
            counted.scored += len(a)
        good = (score >= least[a]) & (score <= most[a])
        a, b, score = a[good], b[good], score[good]
        # every pair against the windows of its anchor, in order
        begin, count = np.searchsorted(anchor, np.arange(len(own))), np.bincount(anchor, minlength=len(own))
        for j in range(int(count.max(initial=0))):
            has = np.flatnonzero(count[a] > j)
            w = begin[a[has]] + j
            inside = (score[has] >= floor[w]) & (score[has] <= high[w])
            best.add(w[inside] + first, score[has][inside], part.ids[b[has][inside]])


# ---- Spark


def _vectors(batch: pa.RecordBatch | pa.Table, references: dict[int, np.ndarray]) -> Iterator[Vectors]:
    """The rows of a batch, by their number of components."""
    if not batch.num_rows:
        return
    lists = batch.column("vector")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat, begin = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    norms = batch.column("norm").to_numpy() if "norm" in batch.schema.names else None
    angles = batch.column("angles") if norms is not None else None
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        values = flat[begin[own][:, None] + np.arange(size)]
        refs = references.get(int(size), np.empty((0, size)))
        if norms is None:
            n = np.linalg.norm(values, axis=1)
            stored = angles_to(values, n, refs)
        else:
            n = norms[own]
            column = (angles.combine_chunks() if isinstance(angles, pa.ChunkedArray) else angles).take(pa.array(own))
            stored = column.flatten().to_numpy().reshape(len(own), len(refs))
        yield Vectors(ids[own], labels[own], values, n, stored)


def prepared(embeddings: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, vector`` (whole numbers) of the rows that take part.

    Rows without id, label or vector, or with a null or non-finite component, before or after scaling, don't.
    Of rows with one id the one with the smallest label counts, of these the smallest vector.
    """
    scaled = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("vector"))
    rows = rows.filter("vec_id is not null and label is not null and vector is not null")
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    twice = checkpointed(rows.groupBy("vec_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("vec_id"))
    if twice.isEmpty():
        return rows
    one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_row"))
    return rows.join(twice, "vec_id", "left_anti").unionByName(one.select("vec_id", "_row.label", "_row.vector"))


def _stored(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Write rows with their norms and angles, near directions beside each other in every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            floored = pa.ListArray.from_arrays(column.offsets, pa.array(np.floor(column.values.to_numpy(zero_copy_only=False))))
            for v in _vectors(batch.set_column(batch.schema.get_field_index("vector"), "vector", floored), references):
                nearest = v.angles.argmin(axis=1) if v.angles.shape[1] else np.zeros(len(v), np.int64)
                width = v.values.shape[1]
                lists = lambda x, n: pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * n, pa.array(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.ids), pa.array(v.labels), lists(v.values, width), pa.array(v.norms), lists(v.angles, v.angles.shape[1]), pa.array(nearest.astype(np.int32)),
                     pa.array(v.angles.min(axis=1) if v.angles.shape[1] else np.zeros(len(v)))],
                    ["vec_id", "label", "vector", "norm", "angles", "nearest", "angle"])

    schema = "vec_id long, label long, vector array<double>, norm double, angles array<double>, nearest int, angle double"
    path = scratch_path(rows.sparkSession, "angles")
    rows.mapInArrow(run, schema).sortWithinPartitions("nearest", "angle").drop("nearest", "angle").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _merged(vectors: list[Vectors]) -> dict[int, Vectors]:
    """By number of components, in ascending order of the ids."""
    out: dict[int, list[Vectors]] = {}
    for v in vectors:
        out.setdefault(v.values.shape[1], []).append(v)
    whole = {n: Vectors(*(np.concatenate([getattr(v, f) for v in vs]) for f in ("ids", "labels", "values", "norms", "angles"))) for n, vs in out.items()}
    return {n: v.take(np.argsort(v.ids, kind="stable")) for n, v in whole.items()}


def hard_negatives(
    embeddings: DataFrame,
    anchors: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    anchors_at_once: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows that ``anchors`` names.

    A score is the inner product of whole numbers (``prepared``); higher ones come first, ties by smaller id. An
    anchor's positives are the first ``positives`` other rows of its label; a positive's negatives the first
    ``negatives`` rows of other labels whose score lies between 30 and 90 hundredths of the positive's. A negative
    positive score leaves no such row. Only vectors of one number of components are compared. Anchors without
    positives, and positives without negatives, give no rows; nor does an empty table. Ties and repeated rows are
    settled by id, see ``prepared``; other columns aren't read.
    """
    spark = embeddings.sparkSession
    rows = prepared(embeddings, label if label is not None else F.col("label"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(REFERENCE_SAMPLE).toArrow()
    references: dict[int, np.ndarray] = {}
    if sample.num_rows:
        references = {n: choose_references(np.floor(v.values)) for n, v in _merged(list(_vectors(sample, {}))).items()}
    stored = _stored(rows, references)
    seeds = _merged(list(_vectors(stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(REFERENCE_SAMPLE).toArrow(), references)))
    asked = stored.filter(anchors)
    blocks = max(1, -(-asked.count() // anchors_at_once))
    out = scratch_path(spark, "negatives")
    found = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], found).write.parquet(out)
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        mine = _merged(list(_vectors(own, references)))
        if mine:
            _mine_block(stored, mine, seeds, references, positives, negatives).write.mode("append").parquet(out)
    return spark.read.schema(found).parquet(out)


def _first(rows: DataFrame, group: list[str], keep: int, score: str, ident: str) -> DataFrame:
    """The best ``keep`` of each group; Spark cuts to as many per group in each task before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), ident)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _mine_block(stored: DataFrame, mine: dict[int, Vectors], seeds: dict[int, Vectors], references: dict[int, np.ndarray], positives: int, negatives: int) -> DataFrame:
    """All negatives of one block of anchors."""
    sc = stored.sparkSession.sparkContext
    # the sample tells what the last of the best must reach at least
    floors = {}
    for n, anchors in mine.items():
        best = Best(len(anchors), positives)
        if n in seeds:
            find_positives(anchors, seeds[n], best)
            best.rows()
        floors[n] = best.floor
    shared = sc.broadcast((mine, floors, references))  # as many anchors as the parameter says, about

    def look_for_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, floors, references = shared.value
        best = {n: Best(len(v), positives, floors[n]) for n, v in mine.items()}
        for batch in batches:
            for v in _vectors(batch, references):
                if (n := v.values.shape[1]) in mine:
                    find_positives(mine[n], v, best[n])
        for n, b in best.items():
            group, score, row = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(mine[n].ids[group]), pa.array(row), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])

    close = stored.mapInArrow(look_for_positives, "anchor_id long, positive_id long, positive_score long")
    close = _first(close, ["anchor_id"], positives, "positive_score", "positive_id").drop("rank").toArrow()
    anchor_id, positive_id, positive_score = (close.column(c).to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))
    goals = {}
    for n, anchors in mine.items():
        at = np.minimum(np.searchsorted(anchors.ids, anchor_id), len(anchors) - 1)
        here = np.flatnonzero(anchors.ids[at] == anchor_id)
        here = here[np.lexsort((positive_id[here], at[here]))]
        windows = Windows.of(at[here], positive_score[here])
        best = Best(len(here), negatives)
        if n in seeds:
            find_negatives(anchors, seeds[n], windows, best)
            best.rows()
        goals[n] = windows, positive_id[here], positive_score[here], best.floor
    wanted = sc.broadcast(goals)

    def look_for_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mine, _, references), goals = shared.value, wanted.value
        best = {n: Best(len(g[1]), negatives, g[3]) for n, g in goals.items()}
        for batch in batches:
            for v in _vectors(batch, references):
                if (n := v.values.shape[1]) in mine:
                    find_negatives(mine[n], v, goals[n][0], best[n])
        for n, b in best.items():
            group, score, row = b.rows()
            windows, ids, scores, _ = goals[n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine[n].ids[windows.anchor[group]]), pa.array(ids[group]), pa.array(row), pa.array(scores[group]), pa.array(score)],
                ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    far = stored.mapInArrow(look_for_negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    far = _first(far, ["anchor_id", "positive_id"], negatives, "negative_score", "negative_id")
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
