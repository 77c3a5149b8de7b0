"""Boosting and forests: sums against plain loops, one task against several, and what the settings mean."""

import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationloom.operators import boosting as B
from stationloom.operators import forest, impute
from stationloom.operators.encoding import TargetShares


def binned(x, nominal=()):
    ends = []
    for f in range(x.shape[1]):
        u = np.unique(x[:, f])
        ends.append(None if f in nominal else (u[1:] + u[:-1]) / 2)
    return B.Binning(ends, [int(x[:, f].max()) + 1 if e is None else len(e) + 1 for f, e in enumerate(ends)])


def rows_of(spark, x, y, parts=1):
    return spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(parts)


def two_features(n=600, seed=3):
    """A label that follows from two features together and from neither alone, and a nominal one that moves it."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 20, n), rng.integers(0, 6, n), rng.integers(0, 9, n)]).astype(float)
    y = ((x[:, 0] >= 10) ^ (x[:, 1] >= 8)).astype(int)
    return x, np.where(np.isin(x[:, 2], [1, 4]), 2, y)


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 6, 80), rng.integers(0, 4, 80)]).astype(float)
    y = rng.normal(size=80)
    s = B.Settings(1, rounds=1, rate=1.0, depth=1, l1=0.3, l2=2.0, min_rows=5)
    binning = binned(x)
    part = B.Part(0, binning.apply(x), y, np.ones(80), np.zeros(80, bool), np.zeros(1))
    (tree,), _ = B._rounds(part, s, B.Chooser(s, binning), 0, 1)[0][0], None
    shrunk = lambda g: np.sign(g) * max(abs(g) - 0.3, 0)
    worth = lambda m: shrunk(-y[m].sum()) ** 2 / (m.sum() + 2)
    every = np.ones(80, bool)
    best = max((worth(x[:, f] <= c) + worth(x[:, f] > c) - worth(every), f, c) for f in (0, 1) for c in range(6)
               if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) >= 5)
    assert (tree.gain[0], tree.feature[0]) == (pytest.approx(best[0]), best[1])
    side = x[:, best[1]] <= best[2]
    assert tree.value[tree.left[0]] == pytest.approx(-shrunk(-y[side].sum()) / (side.sum() + 2))
    stump = B.Settings(1, rounds=1, depth=1, min_gain=best[0] + 1)
    part = B.Part(0, binning.apply(x), y, np.ones(80), np.zeros(80, bool), np.zeros(1))
    assert B._rounds(part, stump, B.Chooser(stump, binning), 0, 1)[0][0][0].feature == [-1]


GROWN = {
    "levels": {"depth": 4, "l2": 1.0, "curvature": 2.0, "min_weight": 1.0}, "leaves": {"depth": 6, "leaves": 9, "min_rows": 5, "l1": 0.1},
    "symmetric": {"depth": 4, "symmetric": True, "l2": 3.0},
}


@pytest.mark.parametrize("kind", GROWN)
def test_interacting_features_are_learnt_and_tasks_agree(spark, kind):
    x, y = two_features()
    nominal = {} if kind == "symmetric" else {2: 6}
    s = B.Settings(3, rounds=12, rate=0.3, **GROWN[kind])
    one = B.fit(rows_of(spark, x, y), s, nominal)
    several = B.fit(rows_of(spark, x, y, 3), s, nominal, tasks=3)
    assert (one.probabilities(x).argmax(axis=1) == y).all()
    assert np.allclose(one.margins(x), several.margins(x), atol=1e-6)
    # a stump sees one feature at a time and can't
    stump = B.fit(rows_of(spark, x, y), B.Settings(3, rounds=30, rate=0.3, depth=1), {2: 6})
    assert (stump.probabilities(x).argmax(axis=1) == y).mean() < 0.9
    if kind == "leaves":
        assert max(sum(f < 0 for f in t.feature) for t in one.trees) <= 9
    if kind != "symmetric":
        assert any(t.groups for t in one.trees)
    again = B.Boosted.from_state(one.to_state())
    assert np.array_equal(again.margins(x), one.margins(x)) and again.importances().sum() == pytest.approx(1)
    assert one.importances()[:3].min() > 0.05 > one.importances()[3]


@pytest.mark.parametrize("kind", GROWN)
def test_squared_error_in_several_tasks(spark, kind):
    x, y = two_features(300)
    s = B.Settings(1, rounds=6, rate=0.3, **GROWN[kind])
    one = B.fit(rows_of(spark, x, y * 10), s, binning=binned(x))
    several = B.fit(rows_of(spark, x, y * 10, 3), s, binning=binned(x), tasks=3)
    assert several.start == pytest.approx(np.mean(y * 10)) and np.allclose(one.margins(x), several.margins(x), atol=1e-6)


def test_symmetric_margins_follow_from_the_trees():
    x, y = two_features(900)
    binning = binned(x)
    for share in (1.0, 0.6):
        s = B.Settings(3, rounds=4, rate=0.3, depth=4, symmetric=True, l2=3.0, row_share=share)
        part = B.Part(0, binning.apply(x), y.astype(float), np.ones(len(y)), np.zeros(len(y), bool), np.zeros(3))
        rounds, _ = B._rounds(part, s, B.Chooser(s, binning), 0, 4)
        assert part.bins.size < 20_000 and np.allclose(part.margin, B.Boosted(s, binning, np.zeros(3), rounds, []).margins(x))
        large = B.Part(0, np.tile(part.bins, (30, 1)), np.tile(part.y, 30), np.ones(30 * len(y)), np.zeros(30 * len(y), bool), np.zeros(3))
        rounds, _ = B._rounds(large, s, B.Chooser(s, binning), 0, 4)
        assert np.allclose(large.margin, np.tile(B.Boosted(s, binning, np.zeros(3), rounds, []).margins(x), (30, 1)))


def test_leaf_wise_growth_takes_the_most_gaining_leaves():
    x, y = two_features()
    binning = binned(x)
    full = B.Settings(3, rounds=1, depth=5)
    few = B.Settings(3, rounds=1, depth=5, leaves=6)
    grown = []
    for s in (full, few):
        part = B.Part(0, binning.apply(x), y.astype(float), np.ones(len(y)), np.zeros(len(y), bool), np.zeros(3))
        grown.append(B._rounds(part, s, B.Chooser(s, binning), 0, 1)[0][0])
    for whole, cut in zip(*grown, strict=True):
        known = {n: B.Choice(whole.gain[n], whole.feature[n]) for n in range(len(whole.feature))}
        want = B.pruned(whole, set(B.wanted(whole, known, 6)))
        assert sorted(zip(want.feature, want.cut, np.round(want.value, 9))) == sorted(zip(cut.feature, cut.cut, np.round(cut.value, 9)))


def test_rounds_in_segments_and_refreshes_are_the_same(spark, monkeypatch):
    x, y = two_features(200)
    s = B.Settings(3, rounds=7, depth=3, row_share=0.7, column_share=0.5)
    whole = B.fit(rows_of(spark, x, y), s, binning=binned(x))
    monkeypatch.setattr(B, "SEGMENT", 3)
    monkeypatch.setattr(B, "REFRESH", 2)
    assert np.array_equal(B.fit(rows_of(spark, x, y), s, binning=binned(x)).margins(x), whole.margins(x))
    plain = B.Settings(3, rounds=5, depth=3)
    assert np.allclose(B.fit(rows_of(spark, x, y, 2), plain, binning=binned(x), tasks=2).margins(x), B.fit(rows_of(spark, x, y), plain, binning=binned(x)).margins(x))


def test_rows_held_back_are_only_looked_at(spark):
    x, y = two_features(300)
    df = rows_of(spark, x, y).withColumn("h", F.xxhash64("x") % 3 == 0)
    s = B.Settings(3, rounds=6, depth=3, rate=0.5)
    found = B.fit(df, s, held="h", binning=binned(x))
    rest = B.fit(df.filter("not h"), s, binning=binned(x))
    assert np.allclose(found.margins(x), rest.margins(x)) and len(found.losses) == 6 and found.losses[-1] < found.losses[0]
    assert B.fit(df.repartition(2), s, held="h", binning=binned(x), tasks=2).losses == pytest.approx(found.losses)
    with pytest.raises(ValueError, match="no rows"):
        B.fit(df.limit(0), s)


@pytest.mark.parametrize("kind", ["lgbm", "cboost"])
def test_a_chain_over_several_tasks(spark, kind, monkeypatch):
    monkeypatch.setattr(impute, "TASK_ROWS", 100)
    rows = [(float(k % 30), None if k % 7 == 3 else 100.0 * (k % 30 >= 15)) for k in range(300)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    chain = impute.fit_tree_chain(df, ["x", "y"], kind, rounds=1, maxIter=25, maxDepth=3)
    assert all(abs(r["y"] - 100.0 * (r["x"] >= 15)) < 10 for r in chain.apply(df).collect())


def test_bins_lie_between_neighbouring_values(spark):
    x = np.array([[-1e9, 0], [1, 1], [1, 1], [4, 2], [10, 0]])
    binning = B.Binning.fit(rows_of(spark, x, x[:, 0], 3), F.col("x"), 2, {1: 3})
    assert binning.ends[1] is None and binning.sizes == [4, 3]
    assert binning.ends[0].tolist() == [(1 - 1e9) / 2, 2.5, 7.0]
    assert binning.apply(np.array([[2.4, 9.0], [2.6, -1]])).tolist() == [[1, 2], [2, 0]]
    many = np.arange(5000.0)[:, None]
    few = B.Binning.fit(rows_of(spark, many, many[:, 0], 4), F.col("x"), 1, {}, bins=50)
    assert 40 <= few.sizes[0] <= 52 and np.bincount(few.apply(many)[:, 0]).max() < 200


def test_ordered_shares_never_see_a_row_s_own_label(spark):
    rng = np.random.default_rng(8)
    rows = [(k, "hot" if k % 3 else f"c{k % 7}", int(rng.integers(0, 2)), k % 11 == 0) for k in range(300)] + [(300, None, 1, False)]
    df = spark.createDataFrame(rows, "row_id long, c string, y int, h boolean").repartition(5)
    known = df.filter("not h")
    shares = TargetShares.fit(known, ["c"], "y", 2)
    got = shares.ordered(df, "row_id", "y", 7, ["a", "b"], "h").select("row_id", "a", "b").collect()
    order = {r["row_id"]: r["o"] for r in df.select("row_id", F.xxhash64("row_id", F.lit(7)).alias("o")).collect()}
    overall = np.array(shares.overall)
    for r in got:
        k, c, y, h = rows[r["row_id"]]
        told = [o for o in rows if not o[3] and o[1] == c and (h or order[o[0]] < order[k])]
        n = np.bincount([o[2] for o in told], minlength=2)
        assert [r["a"], r["b"]] == pytest.approx(((n + overall) / (n.sum() + 1)).tolist())
    assert len(got) == 301
    # labels drawn at random: ordered shares tell nothing about them
    mine = np.array([[r["b"], rows[r["row_id"]][2]] for r in got if rows[r["row_id"]][1] == "hot" and not rows[r["row_id"]][3]])
    assert abs(np.corrcoef(mine.T)[0, 1]) < 0.2


def test_forest_splits_down_to_single_rows(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.permutation(120), rng.integers(0, 5, 120)]).astype(float)
    y = 10.0 * (x[:, 0] >= 60) + x[:, 1] + 0.01 * x[:, 0]
    df = rows_of(spark, x, y, 3)
    a, b = (forest.fit_forest(d, "x", "y", binned(x), trees=20) for d in (df, df.repartition(5)))
    assert np.array_equal(a.margins(x), b.margins(x))
    assert np.abs(a.margins(x)[:, 0] - y).max() < 8 and np.abs(a.margins(x)[:, 0] - y).mean() < 0.5
    # a tree reproduces the rows that it has drawn
    bins = binned(x).apply(x)
    tree = forest.grow_forest(bins, y, np.array([4]), max(binned(x).sizes), 1000, 1, 42)[0]
    drawn = np.unique(np.random.default_rng((42, 4)).integers(0, 120, 120))
    assert np.allclose(tree.predict(bins)[drawn], y[drawn])
    assert max(len(t.feature) for t in a.trees) > 60
    assert np.array_equal(forest.Forest.from_state(a.to_state()).margins(x), a.margins(x))


@pytest.mark.parametrize("kind", ["rf", "lgbm", "cboost"])
def test_chained_trees_find_the_rule_that_fills_a_column(spark, kind, monkeypatch):
    rng = np.random.default_rng(6)
    n = 300
    x, z = rng.integers(0, 30, n).astype(float), rng.integers(0, 8, n).astype(float)
    y = 100.0 * (x >= 15) + 10 * z
    gaps = rng.random(n) < 0.1
    rows = [(k, x[k], None if gaps[k] else y[k], None if k % 29 == 3 else z[k]) for k in range(n)]
    df = spark.createDataFrame([(k, float(a), None if b is None else float(b), None if c is None else float(c)) for k, a, b, c in rows], "row_id long, x double, y double, z double")
    chain = impute.fit_tree_chain(df, ["x", "y", "z"], kind, rounds=2)
    got = {r["row_id"]: r for r in chain.apply(df).collect()}
    sure = [k for k in range(n) if gaps[k] and k % 29 != 3]
    assert len(sure) > 15 and np.mean([abs(got[k]["y"] - y[k]) for k in sure]) < 5
    assert all(got[k]["y"] == y[k] for k in range(n) if not gaps[k]) and all(r["z"] is not None for r in got.values())
    again = impute.TreeChain.from_state(chain.to_state()).apply(df)
    assert {r["row_id"]: r["y"] for r in again.collect()} == {k: r["y"] for k, r in got.items()}
    if kind == "rf":  # larger tables take Spark's forest
        monkeypatch.setattr(forest, "MOST_ROWS", 10)
        large = impute.fit_tree_chain(df, ["x", "y", "z"], kind, rounds=1, numTrees=5, maxDepth=8)
        assert large.of_spark and large.apply(df).filter("y is null or z is null").isEmpty()


def test_symmetric_levels_cut_off_classes_smaller_than_the_bound_on_leaves():
    # 40 rows in three classes: no cut leaves 30 rows on both sides, yet the classes follow from the one feature
    x = np.arange(40.0)[:, None]
    y = np.digitize(x[:, 0], [10, 25])
    s = B.Settings(3, rounds=30, rate=0.3, depth=2, symmetric=True, l2=3.0, min_rows=30)
    binning = binned(x)
    part = B.Part(0, binning.apply(x), y, np.ones(40), np.zeros(40, bool), np.zeros(3))
    B._rounds(part, s, B.Chooser(s, binning), 0, 30)
    assert (part.margin.argmax(axis=1) == y).all()


def gapped(spark, n=400):
    rng = np.random.default_rng(9)
    x, z = rng.normal(size=n), rng.normal(size=n)
    rows = [(k // 2 if k % 50 else None, float(x[k]), None if k % 9 == 4 else float(x[k] * 3 + z[k]), None if k % 31 == 3 else float(z[k]), f"t{k}") for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, x double, y double, z double, t string").repartition(3)


def test_a_chain_of_forests_leaves_its_trees_in_the_shared_folder(spark):
    chain = impute.fit_tree_chain(gapped(spark), ["x", "y", "z"], "rf", rounds=2, numTrees=30)
    assert len(chain.steps) == 4
    trees = sum(len(pickle.dumps(t)) for _, m in chain.steps for t in m.trees)
    # what the driver holds doesn't grow with the trees
    assert len(pickle.dumps(chain)) < 20_000 < trees / 5
    assert len(json.dumps(chain.to_state())) < 50_000


def test_forests_of_a_chain_answer_for_rows_with_gaps_in_blocks(spark, tmp_path, monkeypatch):
    df = gapped(spark)
    chain = impute.fit_tree_chain(df, ["x", "y", "z"], "rf", rounds=2, numTrees=12)
    names, rows = ["x", "y", "z"], df.collect()
    x = np.array([[chain.means[c] if r[c] is None else r[c] for c in names] for r in rows])
    for target, model in chain.steps:
        at, gap = names.index(target), np.array([r[target] is None for r in rows])
        x[gap, at] = model.margins(np.delete(x[gap], at, axis=1))[:, 0]
    want = {r["t"]: (r["row_id"], *v) for r, v in zip(rows, x.tolist(), strict=True)}
    monkeypatch.setattr(impute, "BLOCK_ROWS", 7)
    state = chain.stored(str(tmp_path / "a"))
    (tmp_path / "a").rename(tmp_path / "b")
    for some in (chain, impute.TreeChain.restored(json.loads(json.dumps(state)), str(tmp_path / "b"))):
        done = some.apply(df)
        assert done.columns == df.columns
        assert {r["t"]: tuple(r)[:4] for r in done.collect()} == want and done.count() == 400
    whole = df.where("y IS NOT NULL AND z IS NOT NULL")
    assert sorted(map(str, chain.apply(whole).collect())) == sorted(map(str, whole.collect()))


def test_trees_take_the_best_cut_of_all():
    rng = np.random.default_rng(7)
    bins, y = rng.integers(0, 9, (90, 3)).astype(np.uint8), rng.normal(size=90)
    drawn = np.bincount(np.random.default_rng((5, 2)).integers(0, 90, 90), minlength=90)
    for min_rows in (1, 8):
        tree = forest.grow_forest(bins, y, np.array([2]), 9, 4, min_rows, 5)[0]

        def leaves(rows, depth, least=min_rows):
            def spread(m):
                return (drawn[m] * (y[m] - np.average(y[m], weights=drawn[m])) ** 2).sum()
            cuts = [(spread(a) + spread(b), a, b) for f in range(3) for c in range(8) for a in [rows[bins[rows, f] <= c]] for b in [rows[bins[rows, f] > c]]
                    if drawn[a].sum() >= least and drawn[b].sum() >= least]
            if not cuts or not depth:
                return {int(r): np.average(y[rows], weights=drawn[rows]) for r in rows}
            _, a, b = min(cuts, key=lambda c: c[0])
            return leaves(a, depth - 1) | leaves(b, depth - 1)
        want = leaves(np.flatnonzero(drawn), 4)
        assert np.allclose(tree.predict(bins)[list(want)], list(want.values()))
