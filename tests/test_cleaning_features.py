import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationloom import fixtures as X
from stationloom import schema as S
from stationloom.functions import cleaning as C
from stationloom.functions import numeric as N
from stationloom.operators import impute as I
from stationloom.operators import rows as R
from stationloom.operators import summaries as A
from stationloom.operators import transforms as L
from stationloom.plans import cleaning as P
from stationloom.plans.features import FeatureEngineer, FeatureEngineerModel

GATE = "mean_population_density_5km_year2015"


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def stations(spark, rows):
    ddl = f"row_id bigint, lat double, lon double, timezone string, type_of_area string, altitude double, {S.SRTM_90M} double, {S.ROAD} double, {GATE} double, {S.LANDCOVER} string"
    return spark.createDataFrame(rows, ddl)


def test_null_coordinates_are_duplicates_of_each_other(spark):
    df = spark.createDataFrame([(2, None, None), (1, None, None), (3, 1.0, None), (4, 1.0, 2.0), (5, 1.0, 2.0)],
                               "row_id bigint, lat double, lon double")
    assert sorted(values(R.keep_first(df), "row_id")) == [1, 3, 4]
    assert sorted(values(R.duplicate_rows(df), "row_id")) == [1, 2, 4, 5]
    assert values(R.keep_first(df.select("row_id")), "row_id") == [2, 1, 3, 4, 5]


def test_structural_cleaning_by_hand(spark):
    rows = [
        (1, 1.0, 1.0, " Asia /Tokyo", "urban", 9999.0, 20.0, 5.0, 1.0, "11 Crop"),
        (2, 1.0, 1.0, "CET", "rural", 1.0, 1.0, 1.0, 1.0, "20 Later duplicate"),
        (3, 2.0, 1.0, "Mars/Base", "rural", 30.0, None, -1.0, 2.0, None),
        (4, 3.0, 1.0, "CET", "unknown", -999.0, None, 3.0, -9999.0, "-999 none"),
        (5, 4.0, 1.0, None, "unknown", -999.0, 9999.0, None, 4.0, "-999 none"),
    ]
    out = {r["row_id"]: r for r in P.structural(stations(spark, rows)).collect()}
    assert set(out) == {1, 3, 5}
    assert out[1]["timezone"] == "Asia" and out[1]["altitude"] == 20.0 and out[1][S.LANDCOVER] == 10.0
    assert out[3]["timezone"] is None and out[3][S.SRTM_90M] == 30.0 and out[3][S.LANDCOVER] is None
    assert out[5]["altitude"] == 9999.0 and out[5][S.LANDCOVER] == -1000.0
    first = {r["row_id"]: r for r in P.structural(stations(spark, rows), sentinels_first=True).collect()}
    assert first[5][S.LANDCOVER] is None
    done = {r["row_id"]: r for r in P.finish(P.structural(stations(spark, rows))).collect()}
    assert set(done) == {1} and done[1][S.LANDCOVER] == "10.0"
    assert {r["step"]: (r["rows_in"], r["rows_out"]) for r in P.audit(stations(spark, rows)).collect()} == {
        "duplicates": (5, 4), "missing_gate": (4, 3), "road_distance": (3, 1)}


def test_gate_without_columns_is_skipped(spark):
    df = spark.createDataFrame([(1, None)], "row_id bigint, altitude double")
    assert R.gate_missing(df).count() == 1 and R.gate_missing(df, mode="all").count() == 1


def test_code_text(spark):
    df = spark.createDataFrame([("10 Crop",), ("nan",), (None,), ("7",), ("8.0",)], "c string")
    assert values(df.select(C.code_of(F.col("c")).alias("x")), "x") == [10.0, None, None, 7.0, 8.0]
    with pytest.raises(Exception, match="not a number: Crop"):
        spark.createDataFrame([("Crop 10",)], "c string").select(C.code_of(F.col("c"))).collect()


def test_empty_input_and_everything_dropped(spark):
    rows = [(1, 1.0, 1.0, "CET", "urban", 1.0, 1.0, 1.0, None, "1 x")]
    df = stations(spark, rows)
    assert P.StationCleaner(imputer="mean").fit(df).transform(df).count() == 0
    empty = df.limit(0)
    assert P.StationCleaner(impute=False).fit(empty).transform(empty).count() == 0


def test_unfitted_and_missing(spark, tmp_path):
    with pytest.raises(RuntimeError):
        P.StationCleaner().transform(None)
    with pytest.raises(RuntimeError):
        P.StationCleaner().save("x")
    with pytest.raises(FileNotFoundError):
        P.StationCleanerModel.restore(str(tmp_path / "nothing"))
    with pytest.raises(RuntimeError):
        FeatureEngineer().transform(None)


def ridge_by_rows(x, rounds, tol=1e-3):
    """Row-by-row chained Bayesian ridge, the slow way."""
    def fit(a, y):
        am, ym = a.mean(axis=0), y.mean()
        a, y = a - am, y - ym
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None
        for _ in range(300):
            coef = vt.T @ ((vt @ (a.T @ y)) / (s**2 + lam / alpha))
            gamma = (alpha * s**2 / (lam + alpha * s**2)).sum()
            lam = (gamma + 2e-6) / ((coef**2).sum() + 2e-6)
            alpha = (len(y) - gamma + 2e-6) / (((y - a @ coef) ** 2).sum() + 2e-6)
            if old is not None and np.abs(old - coef).sum() < tol:
                break
            old = coef
        coef = vt.T @ ((vt @ (a.T @ y)) / (s**2 + lam / alpha))
        return coef, ym - am @ coef
    holes = np.isnan(x)
    z = np.where(holes, np.nanmean(x, axis=0), x)
    order = [c for c in np.argsort(holes.sum(axis=0), kind="stable") if holes[:, c].any()]
    for _ in range(rounds):
        before = z.copy()
        for c in order:
            rest = [i for i in range(x.shape[1]) if i != c]
            coef, b = fit(z[~holes[:, c]][:, rest], z[~holes[:, c], c])
            z[holes[:, c], c] = z[holes[:, c]][:, rest] @ coef + b
        if np.abs(z - before).sum(axis=1).max() < tol * np.abs(x[~holes]).max():
            break
    return z


@pytest.mark.parametrize("max_patterns", [I.MAX_PATTERNS, 0])
def test_linear_chain_equals_row_by_row(spark, max_patterns):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 2))
    x = np.column_stack([base[:, 0] * 5 + 100, base @ [1.0, 2.0] + rng.normal(0, 0.1, 300), base[:, 1] * 3,
                         base[:, 0] - base[:, 1] + rng.normal(0, 0.2, 300)])
    holes = rng.random(x.shape) < [0.0, 0.1, 0.3, 0.2]
    x[holes] = np.nan
    names = list("abcd")
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, d double").repartition(4)
    chain = I.fit_linear_chain(df, names, max_patterns=max_patterns)
    got = np.array([[r[c] for c in names] for r in chain.apply(df).orderBy("row_id").collect()])
    assert np.allclose(got, ridge_by_rows(x.copy(), 10), atol=1e-6)
    again = I.LinearChain.from_state(chain.to_state()).apply(df).orderBy("row_id").collect()
    assert np.allclose(got, [[r[c] for c in names] for r in again])


def test_linear_chain_with_a_pattern_per_row(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(600, 3))
    x = base @ rng.normal(size=(3, 12)) + rng.normal(0, 0.3, (600, 12)) + np.arange(12)
    x[rng.random(x.shape) < 0.35] = np.nan
    x[:5] = np.nan
    assert len(np.unique(np.isnan(x), axis=0)) > I.MAX_PATTERNS
    names = [f"c{i}" for i in range(12)]
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    chain = I.fit_linear_chain(df, names, rounds=3)
    got = np.array([[r[c] for c in names] for r in chain.apply(df).orderBy("row_id").collect()])
    assert np.allclose(got, ridge_by_rows(x.copy(), 3), atol=1e-6)
    same = I.fit_linear_chain(df, names, rounds=3, max_patterns=1 << 12)
    assert [s.target for s in same.steps] == [s.target for s in chain.steps]
    assert np.allclose([s.weights for s in same.steps], [s.weights for s in chain.steps], atol=1e-8)


def test_linear_chain_with_an_empty_column_and_no_row(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, None), (2.0, None, None), (3.0, 6.1, None), (None, 8.0, None)], "a double, b double, c double")
    few, many = (I.fit_linear_chain(df, list("abc"), max_patterns=n) for n in (I.MAX_PATTERNS, 0))
    assert {s.target for s in few.steps} == {0, 1}
    assert np.allclose([s.weights for s in few.steps], [s.weights for s in many.steps])
    assert I.fit_linear_chain(df.where("a > 9"), list("abc"), max_patterns=0).steps == []


def marked_frame(spark, rows):
    schema = ("row_id bigint, lat double, lon double, area_code string, timezone string, altitude double, "
              f"{S.GATE[0]} double, {S.ROAD} double, {S.LANDCOVER} string")
    return spark.createDataFrame(rows, schema)


def test_marked_cleaning_keeps_the_rows_that_cleaning_keeps(spark):
    rows = [(i, 1.0, 2.0, "hot", "Europe/Rome", 5.0, 1.0, 3.0, "10 a") for i in range(40)]  # one hot coordinate
    rows += [(50, None, 3.0, "n1", "Asia/Baku", 1.0, 1.0, 2.0, "20 b"), (49, None, 3.0, "n0", "Asia/Baku", 1.0, 1.0, 2.0, "20 b")]
    rows += [(60, 7.0, 7.0, "gate", None, 1.0, None, 2.0, None), (61, 8.0, 7.0, "road", None, 1.0, 2.0, -999.0, None),
             (62, 9.0, 7.0, "alone", None, 9999.0, 2.0, 0.0, None)]
    df = marked_frame(spark, rows).repartition(5)
    plain = P.StationCleaner(impute=False, gate=[S.GATE[0]]).fit(df)
    got = plain.marked(df)
    back = R.handed_back(got, ["altitude"])
    assert back.count() == len(rows) and back.columns == ["row_id", "lat", "lon", "area_code", "altitude", "survived"]
    assert {r["row_id"] for r in back.where("survived").collect()} == {0, 49, 62}
    columns = plain.transform(df).columns
    same = lambda d: sorted(map(repr, d.select(*columns).collect()))
    assert same(R.kept(got)) == same(plain.transform(df))
    assert plain.marked(df.limit(0)).count() == 0


def test_marked_cleaning_moves_no_row_where_few_keys_repeat(spark, tmp_path):
    from stationloom import fixtures as X
    X.stations_raw(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "raw"))
    model = P.StationCleaner(impute=False).fit(spark.read.parquet(str(tmp_path / "raw")))
    plan = model.marked(spark.read.parquet(str(tmp_path / "raw")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan
    assert plan.count("FileScan") == 2


def test_marked_cleaning_does_not_read_codes_of_dropped_rows(spark):
    rows = [(0, 1.0, 2.0, "a", None, 5.0, 1.0, 3.0, "10 a"), (1, 1.0, 2.0, "b", None, 5.0, 1.0, 3.0, "no code")]
    df = marked_frame(spark, rows)
    for first in (False, True):
        model = P.StationCleaner(impute=False, gate=[S.GATE[0]], sentinels_first=first).fit(df.where("row_id = 0"))
        assert [r[R.MARK] for r in model.marked(df).orderBy("row_id").collect()] == [True, False]


def test_tree_chain_fills_everything_and_survives_storage(spark, sf, tmp_path):
    from stationloom import fixtures as X
    raw = X.stations_raw(spark, sf)
    cleaner = P.StationCleaner(imputer="rf", chain_rounds=1, tree_params={"numTrees": 3, "maxDepth": 3})
    model, out = cleaner.fit_transform(raw)
    numbers = S.numeric_columns(out, S.NUMERIC)
    assert out.where(" OR ".join(f"{c} IS NULL" for c in numbers)).count() == 0
    model.store(str(tmp_path / "m"))
    same = P.StationCleanerModel.restore(str(tmp_path / "m")).transform(raw)
    key = lambda df: sorted(map(tuple, df.select("row_id", *numbers).collect()))
    assert key(same) == key(out)
    with pytest.raises(NotImplementedError):
        P.StationCleaner(imputer="svm").fit(raw)


def test_chained_cleaner_learns_at_fit(spark, sf):
    from stationloom import fixtures as X
    raw = X.stations_raw(spark, sf)
    model = P.StationCleaner().fit(raw)
    one = model.transform(raw.where("row_id = 19"))
    whole = {r["row_id"]: r["altitude"] for r in model.transform(raw).collect()}
    assert one.first()["altitude"] == pytest.approx(whole[19])
    refit = P.StationCleaner(refit_on_transform=True).fit(raw).transform(raw)
    assert {r["row_id"]: r["altitude"] for r in refit.collect()} == pytest.approx(whole)


def test_what_fitting_hands_back_does_not_read_the_raw_rows_again(spark, sf):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    raw = X.stations_raw(spark, sf)
    raw = raw.mapInArrow(counted, raw.schema)
    _, clean = P.StationCleaner(imputer="mean").fit_transform(raw)
    seen = read.value
    assert clean.count() > 0 and clean.where("altitude is null").isEmpty() and read.value == seen


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(5.0, "b"), (2.0, "a"), (5.0, "a"), (2.0, "b"), (None, None)], "n double, s string")
    assert I.column_modes(df, ["n", "s"]) == {"n": 2.0, "s": "a"}
    assert I.column_modes(df.where("n IS NULL"), ["n"]) == {}


def test_scalers_on_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 4.0, None), (2.0, 4.0, None), (3.0, 4.0, None), (10.0, 4.0, None)],
                               "x double, k double, e double")
    for kind in L.SCALERS:
        out = L.apply_scale(df, L.scale_state(df, kind, ["x", "k", "e"])).collect()
        assert [r["k"] for r in out] == [0.0] * 4 and [r["e"] for r in out] == [None] * 4
    std = L.standard_state(df, ["x"])["x"]
    assert std == pytest.approx((4.0, np.std([1, 2, 3, 10])))
    assert L.robust_state(df, ["x"])["x"] == pytest.approx((2.5, 4.75 - 1.75))
    with pytest.raises(ValueError):
        L.scale_state(df, "other", ["x"])
    assert L.iqr_bounds(df, ["x", "e"]) == {"x": (1.75 - 4.5, 4.75 + 4.5)}


def test_skewness_matches_the_corrected_form(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, k double")
    got = A.sample_skewness(df, ["x", "k"])
    assert got["x"] == pytest.approx(1.763632614803888) and got["k"] == 0.0


def test_yeo_johnson_lambda_is_the_best_one(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.exp(rng.normal(2, 0.8, 400)), [-1.0, -0.5]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)

    def transform(lam):
        with np.errstate(all="ignore"):
            up = np.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam
            down = -np.log1p(-x) if abs(lam - 2) < 1e-12 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)
        return np.where(x >= 0, up, down)

    def score(lam):
        return -len(x) / 2 * np.log(transform(lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    lam = L.yeo_johnson_lambdas(df, ["x"])["x"]
    grid = np.linspace(-2, 2, 8001)
    assert lam == pytest.approx(grid[np.argmax([score(v) for v in grid])], abs=1e-3)
    state = L.power_state(df, ["x"])
    out = np.array(values(L.apply_power(df, state), "x"))
    assert out.mean() == pytest.approx(0, abs=1e-9) and out.std() == pytest.approx(1)
    y = np.array(values(df.select(N.yeo_johnson(F.col("x"), 2.0).alias("y")), "y"))
    assert np.allclose(sorted(y), sorted(transform(2.0)))


def test_encoders_on_unseen_values_and_single_rows(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "timezone string")
    new = spark.createDataFrame([("c",)], "timezone string")
    other = spark.createDataFrame([("z",)], "timezone string")
    ohe = FeatureEngineer(encoder="ohe", encode=["timezone"]).fit(train)
    assert ohe.transform(new).first().asDict() == {"timezone_b": 0.0, "timezone_c": 1.0}
    assert ohe.transform(other).first().asDict() == {"timezone_b": 0.0, "timezone_c": 0.0}
    le = FeatureEngineer(encoder="le", encode=["timezone"]).fit(train)
    assert le.transform(new).first()["timezone"] == 2 and le.transform(other).first()["timezone"] == 0


def test_feature_options_are_checked(spark):
    df = spark.createDataFrame([(1.0, "a")], "altitude double, timezone string")
    with pytest.raises(ValueError):
        FeatureEngineer(encoder="other", encode=["timezone"]).fit(df)
    with pytest.raises(ValueError):
        FeatureEngineer(scaling="other").fit(df)
    with pytest.raises(ValueError):
        FeatureEngineer(scaling="standard", scale_only="some").fit(df)
    with pytest.raises(TypeError):
        FeatureEngineer(colour="red")


def test_feature_order_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, float(v), f"{i % 3}.0", "7 x" if i % 2 else "8") for i, v in enumerate(np.exp(rng.normal(0, 1.5, 200)))]
    df = spark.createDataFrame(rows, "row_id bigint, altitude double, climatic_zone_year2016 string, dominant_ecoregion_year2017 string")
    fe = FeatureEngineer(scaling="standard", cap_outliers=True, convert=["dominant_ecoregion_year2017"],
                         encoder="le", encode=["climatic_zone_year2016"])
    model, out = fe.fit_transform(df)
    x = np.array([r[1] for r in rows])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert model.learned["bounds"]["altitude"] == pytest.approx([q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)])
    got = np.array(values(out.orderBy("row_id"), "altitude"))
    assert got.mean() == pytest.approx(0, abs=1e-9) and got.std() == pytest.approx(1)
    assert model.learned["power"] and set(values(out, "climatic_zone_year2016")) == {0, 1, 2}
    assert set(values(out, "dominant_ecoregion_year2017")) == {None, 8.0}
    model.store(str(tmp_path / "fe"))
    again = FeatureEngineerModel.restore(str(tmp_path / "fe")).transform(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_histogram_and_density_edges(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    bins = A.histogram(df, "x").orderBy("bin").collect()
    assert sum(r["n"] for r in bins) == 2 and len(bins) == 10
    assert A.kde_curve(df, "x").count() == 0
    assert A.histogram(df.where("x IS NULL"), "x").agg(F.sum("n")).first()[0] == 0
    more = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert [r["n"] for r in A.histogram(more, "x").orderBy("bin").collect()] == [1] * 9 + [2]


def test_correlation_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 5, (200, 3))
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double")
    got = {(r["row"], r["column"]): r["r"] for r in A.correlations(df.repartition(3), ["a", "b", "c"]).collect()}
    for j, i in [(1, 0), (2, 0), (2, 1)]:
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[("abc"[j], "abc"[i])] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1])


def test_tree_imputers_have_the_sizes_of_the_libraries(spark):
    forest, lgbm, cboost = (I.tree_regressor(k) for k in ("rf", "lgbm", "cboost"))
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 30)
    assert (lgbm.rounds, lgbm.leaves, cboost.rounds, cboost.depth, cboost.symmetric) == (100, 31, 1000, 6, True)
    rows = [(k, float(k), None if k % 20 == 7 else 10.0 * (k >= 30)) for k in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double").coalesce(1)
    done = I.fit_tree_chain(df, ["x", "y"], "lgbm", rounds=1).apply(df)
    got = {r["row_id"]: r["y"] for r in done.collect()}
    assert all(abs(got[k] - 10.0 * (k >= 30)) < 0.01 for k in range(60))
