"""Hard negatives against all pairs, and the bounds against the scores they bound."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, norm string, vector string, angles int, rank int"


def truth(rows, wants, positives=5, negatives=10):
    """(anchor, positive, rank, negative, positive score, negative score), by Python's integers."""
    valid = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(256 * x) for x in e):
            continue
        v = [math.floor(256.0 * x) for x in e]
        one = (label, [256.0 * x for x in e], v)
        if i not in valid or one[:2] < valid[i][:2]:
            valid[i] = one
    score = lambda a, b: min(max(sum(x * y for x, y in zip(valid[a][2], valid[b][2], strict=True)), -(2**63)), 2**63 - 1)
    out = []
    for a in filter(wants, valid):
        mates = [b for b in valid if b != a and len(valid[b][2]) == len(valid[a][2])]
        near = sorted((-score(a, b), b) for b in mates if valid[b][0] == valid[a][0])[:positives]
        for s, p in near:
            far = sorted((-score(a, b), b) for b in mates if valid[b][0] != valid[a][0])
            far = [(-t, b) for t, b in far if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k, b, -s, t) for k, (t, b) in enumerate(far, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, None, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)


def clustered(rng, n, dims=12):
    centres = rng.normal(size=(6, dims))
    at = rng.integers(0, 6, n)
    v = centres[at] + 0.15 * rng.normal(size=(n, dims))
    return v * rng.uniform(0.2, 3, n)[:, None], at


def odd_rows():
    rng = np.random.default_rng(5)
    v, at = clustered(rng, 250)
    rows = [(k, v[k].tolist(), int((at[k] + (k % 5 == 0)) % 4)) for k in range(250)]
    rows += [(300, v[3].tolist(), 1), (301, v[3].tolist(), 2), (302, v[3].tolist(), 2), (303, [0.0] * 12, 1), (304, [0.0] * 12, 2)]  # ties, zero vectors
    rows += [(7, v[9].tolist(), 3), (7, v[9].tolist(), 3), (20, v[1].tolist(), 0), (310, v[4].tolist(), 2), (310, v[5].tolist(), 2)]  # repeated ids
    rows += [(400, None, 1), (401, v[0].tolist(), None), (None, v[0].tolist(), 1), (402, [None] + v[0][1:].tolist(), 1), (403, [math.nan] + v[0][1:].tolist(), 1),
             (404, [math.inf] + v[0][1:].tolist(), 1), (405, [1.7e308] + v[0][1:].tolist(), 1)]
    rows += [(500 + k, v[k][:3].tolist(), k % 2) for k in range(30)] + [(540, [], 1), (541, [], 2), (560, [], 1)]  # other lengths
    rows += [(-40, v[11].tolist(), 1), (-41, v[12].tolist(), 2)]
    return rows


@pytest.mark.parametrize("at_once", [5, 4096])
def test_all_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(H, "REFERENCE_SAMPLE", 60)
    rows = odd_rows()
    want = truth(rows, lambda i: i % 20 == 0)
    assert len(want) > 300 and len({w[0] for w in want}) > 10
    assert found(H.hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0, anchors_at_once=at_once)) == want


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(0, [1e6, 3.0], 1), (1, [1e6 + 0.01, 1.0], 1), (2, [6e5, 1.0], 2), (3, [5e5 + 1 / 256, 0.0], 2), (4, [3e15, 0.0], 1), (5, [1e15, 0.0], 2), (6, [3e5, 7.0], 2)]
    assert found(H.hard_negatives(table(spark, rows), F.col("vec_id") % 2 == 0)) == truth(rows, lambda i: i % 2 == 0)


def test_few_or_no_rows(spark):
    assert found(H.hard_negatives(table(spark, []), F.col("vec_id") % 2 == 0)) == []
    assert found(H.hard_negatives(table(spark, [(1, [1.0], 1)]), F.col("vec_id") % 2 == 0)) == []
    assert found(H.hard_negatives(table(spark, [(0, [1.0], 1), (1, [0.5], 2)]), F.col("vec_id") % 2 == 0)) == []
    assert found(H.hard_negatives(table(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.95], 2)]), F.col("vec_id") == 0)) == [
        (0, 1, 1, 2, 65536, 32768)]


def vectors(values, references, labels):
    values = np.floor(256 * values)
    norms = np.linalg.norm(values, axis=1)
    return H.Vectors(np.arange(len(values)), labels, values, norms, H.angles_to(values, norms, references))


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dims, kind in ((2, 0), (3, 1), (12, 1), (64, 0)):
        v, at = clustered(rng, 400, dims) if kind else (rng.normal(size=(400, dims)) * rng.uniform(0, 5, 400)[:, None], np.zeros(400, int))
        v[:3] = 0
        v[3:9] = v[20]
        v[9] = -v[20]
        rows = vectors(v, H.choose_references(v, 6), at)
        a = rows.take(slice(0, 60))
        exact = a.values @ rows.values.T
        assert (H.score_floor(a, rows) <= exact).all() and (exact <= H.score_ceiling(a, rows)).all()
        ceiling = np.repeat(H.block_ceiling(a, rows, 16), 16, axis=1)[:, : len(rows)]
        assert (exact <= ceiling).all()


def test_bounds_discard_pairs_where_directions_differ():
    rng = np.random.default_rng(4)
    v, at = clustered(rng, 6000)
    rows = vectors(v, H.choose_references(v[:500], 8), at % 3)
    order = np.lexsort((rows.angles.min(axis=1), rows.angles.argmin(axis=1)))
    anchors, counted = rows.take(slice(0, 60)), H.Counted()
    best = H.Best(60, 5)
    H.find_positives(anchors, rows, best)
    group, score, _ = best.rows()
    again = H.Best(60, 5, best.floor)  # with floors known from a sample, as in a task
    H.find_positives(anchors, rows.take(order), again, counted)
    assert [x.tolist() for x in again.rows()] == [x.tolist() for x in best.rows()]
    assert counted.scored < 0.3 * counted.pairs
    windows, far, counted = H.Windows.of(group, score), H.Best(len(group), 10), H.Counted()
    H.find_negatives(anchors, rows, windows, far)
    far.rows()
    H.find_negatives(anchors, rows.take(order), windows, H.Best(len(group), 10, far.floor), counted)
    assert counted.scored < 0.7 * counted.pairs
