import math

import pytest
from pyspark.sql import functions as F

from stationloom.functions import voting as V
from stationloom.operators import metrics as M

# Rows: label of the source; columns: label given by hand.
HAND = {("rural", "rural"): 14, ("suburban", "rural"): 1, ("suburban", "suburban"): 2, ("suburban", "urban"): 1,
        ("urban", "rural"): 1, ("urban", "suburban"): 2, ("urban", "urban"): 14}


def pairs(spark, counts):
    return spark.createDataFrame([p for p, n in counts.items() for _ in range(n)], "p string, y string")


def test_hand_labelled_stations(spark):
    df = pairs(spark, HAND)
    labels = M.per_label(M.contingency(df, "y", "p"))
    recall = {r["label"]: r["recall"] for r in labels.collect()}
    assert recall == pytest.approx({"rural": 14 / 16, "suburban": 2 / 4, "urban": 14 / 15})
    total = M.overall(labels).first()
    assert total["accuracy"] == pytest.approx(30 / 35)
    assert total["balanced_accuracy"] == pytest.approx(sum(recall.values()) / 3)
    report = {r["label"]: r for r in M.classification_report(df, "y", "p").collect()}
    assert report["urban"]["precision"] == round(14 / 17, 4) and report["accuracy"]["support"] == 35
    cm = {r["y"]: r for r in M.confusion_matrix(df, "y", "p").collect()}
    assert [cm["rural"][f"pred_{c}"] for c in ("rural", "suburban", "urban")] == [14, 1, 1]


def test_class_missing_on_either_side(spark):
    df = pairs(spark, {("urban", "rural"): 2, ("urban", "urban"): 2, ("rural", "rural"): 1, ("suburban", "urban"): 1})
    rows = {r["label"]: r for r in M.per_label(M.contingency(df, "y", "p")).collect()}
    assert rows["suburban"]["precision"] == 0.0 and rows["suburban"]["recall"] == 0.0 and rows["suburban"]["support"] == 0
    total = M.overall(M.per_label(M.contingency(df, "y", "p"))).first()
    assert total["balanced_accuracy"] == pytest.approx((1 / 3 + 2 / 3) / 2)
    assert total["macro_f1"] == pytest.approx((2 / 4 + 4 / 7 + 0) / 3)


def test_agreement_limits(spark):
    same = M.cluster_agreement(pairs(spark, {("a", "x"): 3, ("b", "y"): 4}), "y", "p").first()
    assert same["ari"] == 1.0 and same["nmi"] == pytest.approx(1.0)
    one = M.cluster_agreement(pairs(spark, {("a", "x"): 5}), "y", "p").first()
    assert one["ari"] == 1.0 and one["nmi"] == 1.0
    free = M.cluster_agreement(pairs(spark, {("a", "x"): 5, ("b", "x"): 5, ("a", "y"): 5, ("b", "y"): 5}), "y", "p").first()
    assert free["nmi"] == pytest.approx(0.0, abs=1e-12) and free["ari"] < 0


@pytest.mark.parametrize("votes, winner", [
    (["urban"], "urban"), (["urban", "rural"], "urban"), (["rural", "urban", "urban", "rural"], "rural"),
    (["a", "b", "c", "c"], "c"), (["a", "b", "b", "a"], "a"), (["a", "b", "c", "d"], "a")])
def test_vote(spark, votes, winner):
    df = spark.createDataFrame([(votes,)], "v array<string>")
    assert df.select(V.majority(F.col("v"))).first()[0] == winner


@pytest.mark.parametrize("probs, plain, suburban_first", [
    ([0.5, 0.5, 0.0], "rural", "suburban"), ([0.4, 0.2, 0.4], "suburban", "suburban"), ([0.5, 0.0, 0.5], "rural", "rural"),
    ([0.1, 0.2, 0.7], "urban", "urban"), ([0.2, 0.45, 0.35], "suburban", "suburban"), ([0.0, 0.5, 0.5], "suburban", "suburban")])
def test_threshold_rules(spark, probs, plain, suburban_first):
    df = spark.createDataFrame([(probs,)], "p array<double>")
    got = df.select(V.confident_class(F.col("p"), 0.5), V.confident_class_suburban_first(F.col("p"), 0.5)).first()
    assert tuple(got) == (plain, suburban_first)


def test_grid_equals_scoring_each_threshold(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    probs = rng.dirichlet([1.5, 1.5, 1.5], 300)
    labels = ["rural", "suburban", "urban"]
    rows = [([float(v) for v in p], labels[rng.choice(3, p=p)]) for p in probs]
    df = spark.createDataFrame(rows, "p array<double>, y string")
    for metric, field in (("f1_macro", "macro_f1"), ("balanced_accuracy", "balanced_accuracy")):
        got = {r["threshold"]: r["score"] for r in M.threshold_scores(df, "y", F.col("p"), metric).collect()}
        assert sorted(got) == M.threshold_grid()
        for t in M.threshold_grid()[::12]:
            direct = df.withColumn("q", V.confident_class_suburban_first(F.col("p"), t))
            assert got[t] == pytest.approx(M.overall(M.per_label(M.contingency(direct, "y", "q"))).first()[field])
        best = M.best_threshold(M.threshold_scores(df, "y", F.col("p"), metric)).first()
        assert best["score"] == pytest.approx(max(got.values()))
        assert best["threshold"] == min(t for t, s in got.items() if math.isclose(s, max(got.values()), rel_tol=1e-12))
    with pytest.raises(ValueError):
        M.threshold_scores(df, "y", F.col("p"), "accuracy")
