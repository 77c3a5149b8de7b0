import numpy as np
import pytest
from pyspark.sql import functions as F

from stationloom.operators import sampling as SP
from stationloom.operators.quantiles import exact_quantiles, exact_ranks

TIGHT = {"gather_limit": 8, "accuracy": 20}


def frame(spark, values, name="v", kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id bigint, {name} {kind}").repartition(5)


@pytest.mark.parametrize("options", [{}, TIGHT])
def test_quantiles_with_a_hot_value(spark, options):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(400, 7.5), rng.normal(7, 5, 500), rng.integers(0, 4, 300).astype(float)])
    df = frame(spark, [float(v) for v in values] + [None, float("nan")])
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, {"v": F.col("v")}, probs, **options)["v"]
    assert got == pytest.approx(np.quantile(values, probs).tolist())


def test_search_path_on_skewed_scales_and_integers(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in np.exp(rng.uniform(0, 40, 700))]
    df = frame(spark, values, kind="bigint")
    ranks = [0, 1, 5, 333, 698, 699]
    n, found = exact_ranks(df, {"v": F.col("v")}, lambda _k, _n: ranks, **TIGHT)["v"]
    assert n == 700 and [found[r] for r in ranks] == [sorted(values)[r] for r in ranks]


def test_empty_and_single(spark):
    df = frame(spark, [None, None]).withColumn("one", F.when(F.col("row_id") == 0, 3.0))
    got = exact_quantiles(df, {"v": F.col("v"), "one": F.col("one")}, [0.25, 0.5])
    assert got == {"v": [None, None], "one": [3.0, 3.0]}


def labelled(spark, sizes):
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "row_id bigint, type_of_area string").repartition(4)


@pytest.mark.parametrize("options", [{}, TIGHT])
def test_split_is_exact_and_reproducible(spark, options):
    df = labelled(spark, {"rural": 211, "suburban": 50, "urban": 79})
    train, test = SP.stratified_split(df, 0.15, **options)
    picked = {r["row_id"]: r["type_of_area"] for r in test.collect()}
    assert len(picked) == 51 and train.count() == 340 - 51
    counts = {c: sum(v == c for v in picked.values()) for c in set(picked.values())}
    assert counts == SP.test_quotas({"rural": 211, "suburban": 50, "urban": 79}, 0.15)
    keyed = df.withColumn("k", SP.order_key()).collect()
    for c, q in counts.items():
        best = sorted((r["k"], r["row_id"]) for r in keyed if r["type_of_area"] == c)[:q]
        assert {i for _, i in best} == {i for i, v in picked.items() if v == c}
    again = SP.stratified_split(df.repartition(9), 0.15)[1]
    assert {r["row_id"] for r in again.collect()} == set(picked)


def test_equal_hashes_are_told_apart_by_row_id(spark, monkeypatch):
    df = labelled(spark, {"rural": 20, "urban": 20})
    monkeypatch.setattr(SP, "order_key", lambda *_: F.col("row_id") % 3)
    chosen = SP.first_of_each(df, {"rural": 9, "urban": 0}, {"rural": 20, "urban": 20})
    got = sorted(r["row_id"] for r in df.where(chosen).collect())
    assert got == sorted(sorted(range(20), key=lambda i: (i % 3, i))[:9])


def test_quota_errors():
    with pytest.raises(ValueError):
        SP.test_quotas({"a": 1, "b": 30}, 0.15)
    with pytest.raises(ValueError):
        SP.test_quotas({"a": 3, "b": 3, "c": 3}, 0.15)
    with pytest.raises(ValueError, match="urban"):
        SP.balanced_quotas({"rural": 3, "suburban": 50, "urban": 20}, 90)
    assert SP.balanced_quotas({"rural": 3, "suburban": 50, "urban": 90}, 90) == {"rural": 3, "suburban": 30, "urban": 57}


def test_training_split_guards(spark):
    df = labelled(spark, {"rural": 20, "urban": 20, "unknown": 5})
    df = df.withColumns({"lat": F.col("row_id") * 1.0, "lon": F.lit(1.0)})
    no_keys = spark.createDataFrame([(1,)], "other int")
    assert SP.split_for_training(df, hand_labels=no_keys)[2] is None
    elsewhere = spark.createDataFrame([(-5.0, 2.0)], "lat double, lon double")
    assert SP.split_for_training(df, hand_labels=elsewhere)[2] is None
    here = spark.createDataFrame([(3.0, 1.0), (3.0, 1.0), (44.0, 1.0)], "lat double, lon double")
    train, test, hand = SP.split_for_training(df, hand_labels=here)
    assert [r["row_id"] for r in hand.collect()] == [3]
    assert train.count() + test.count() == 44
    with pytest.raises(ValueError, match="none is left"):
        SP.split_for_training(df, hand_labels=df.select("lat", "lon"))


def test_rows_without_an_id_get_a_stable_one(spark):
    df = labelled(spark, {"rural": 40, "urban": 60}).drop("row_id")
    train, test = SP.stratified_split(df)
    assert test.count() == 15 and train.count() == 85
    assert not {r["row_id"] for r in test.collect()} & {r["row_id"] for r in train.collect()}
