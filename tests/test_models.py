import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stationloom.operators import oversampling as O
from stationloom.operators import projection as PR
from stationloom.operators.silhouette import exact_silhouette
from stationloom.plans import reports as RP
from stationloom.plans.classification import StationClassifier
from stationloom.plans.clustering import StationClusterer
from stationloom.plans.members import best_round, settings, translate

SMALL = {
    "rf_params": {"n_estimators": 5, "max_depth": 4, "class_weight": "balanced"},
    "catboost_params": {"iterations": 2, "depth": 2, "learning_rate": 0.3},
    "lgbm_params": {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3},
    "xgb_params": {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3},
}


def points_frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


@pytest.fixture(scope="module")
def stations(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        label = ["unknown", "rural", "rural", "rural", "rural", "suburban", "suburban", "urban"][i % 8]
        shift = {"rural": 0.0, "suburban": 4.0, "urban": 8.0, "unknown": 2.0}[label]
        rows.append((i, float(i), 1.0, f"ST{i}", label, float(shift + rng.normal()), float(-shift + rng.normal()),
                     "Asia" if shift > 3 else "Africa"))
    return spark.createDataFrame(
        rows, "row_id bigint, lat double, lon double, area_code string, type_of_area string, a double, b double, zone string").repartition(3)


@pytest.mark.parametrize("block_rows", [5000, 60])
def test_nearest_neighbours_are_exact(spark, block_rows):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(250, 3)), rng.normal(size=(60, 3)) * 0.05 + 4, np.repeat([[9.0, 9, 9]], 120, axis=0),
                        np.repeat([[5.0, 5, 5]], 3, axis=0)])
    df = points_frame(spark, x).repartition(4)
    near = {tuple(r["v"]): np.array(r["near"]) for r in O.nearest_neighbours(df, 5, block_rows).collect()}
    assert len(near) == len(np.unique(x, axis=0))
    for v in x:
        d = np.sort(np.linalg.norm(x - v, axis=1))[1:6]
        assert np.linalg.norm(near[tuple(v)] - v, axis=1) == pytest.approx(d)


def test_neighbours_by_bundles_of_groups(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 6)) + 1e3, np.repeat(rng.normal(size=(1, 6)), 20, axis=0)])
    df = points_frame(spark, x).repartition(3)
    near = {tuple(r["v"]): np.array(r["near"]) for r in O.nearest_neighbours(df, 5, 40, bundle_rows=70).collect()}
    for v in x:
        d = np.sort(np.linalg.norm(x - v, axis=1))[1:6]
        assert np.linalg.norm(near[tuple(v)] - v, axis=1) == pytest.approx(d)
    bundle = O._bundles(np.array([30, 30, 5, 90, 10, 60, 1]), 70)
    assert bundle.tolist() == [0, 0, 0, 1, 2, 2, 3]
    # a point that must visit all groups goes once to each bundle
    everywhere = O._candidates(rng.normal(size=(7, 6)), np.full(7, 1e9), np.full(7, 1e9), bundle)
    (out,) = everywhere([pd.DataFrame({"id": [1], "v": [np.zeros(6)]})])
    assert out["cells"][0].tolist() == [0, 1, 2, 3]


def test_fewer_points_than_neighbours(spark):
    near = O.nearest_neighbours(points_frame(spark, [[0.0, 0], [1, 0], [5, 0]]), 5)
    assert {tuple(r["v"]): r["near"] for r in near.collect()}[(1.0, 0.0)] == [[0.0, 0.0], [5.0, 0.0]]


def test_oversampled_rows_lie_between_neighbours(spark, stations):
    labelled = stations.where("type_of_area <> 'unknown'")
    out = O.oversample(labelled, ["a", "b"], block_rows=10)
    sizes = {r["type_of_area"]: r["count"] for r in out.groupBy("type_of_area").count().collect()}
    assert len(set(sizes.values())) == 1 and set(sizes) == {"rural", "suburban", "urban"}
    assert out.where("row_id IS NOT NULL").count() == labelled.count()
    real = {c: np.array([[r["a"], r["b"]] for r in labelled.where(F.col("type_of_area") == c).collect()]) for c in sizes}
    for r in out.where("row_id IS NULL").collect():
        base, p = real[r["type_of_area"]], np.array([r["a"], r["b"]])
        d = np.linalg.norm(base - p, axis=1)
        gaps = np.linalg.norm(base[:, None] - base[None], axis=2)
        assert np.isclose(d[:, None] + d[None], gaps, atol=1e-9).any()
    same = O.oversample(labelled.repartition(7), ["a", "b"])
    key = lambda f: sorted((r["type_of_area"], round(r["a"], 9), round(r["b"], 9)) for r in f.collect())
    assert key(same) == key(out)
    with pytest.raises(ValueError):
        O.oversample(spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "b", 2.0)], "row_id bigint, type_of_area string, a double"), ["a"])


@pytest.mark.parametrize("block_rows", [1000, 25])
def test_silhouette_by_brute_force(spark, block_rows):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(40, 2)) + 3, [[20.0, 20]]])
    c = np.array([0] * 60 + [1] * 40 + [2])
    df = points_frame(spark, x).withColumn("cluster", F.when(F.col("id") < 60, 0).when(F.col("id") < 100, 1).otherwise(2))
    got = {r["id"]: r["silhouette"] for r in exact_silhouette(df, "id", "v", block_rows=block_rows).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(len(x)):
        n = (c == c[i]).sum()
        a = d[i, c == c[i]].sum() / max(n - 1, 1)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        assert got[i] == pytest.approx(0.0 if n == 1 else (b - a) / max(a, b))


def test_silhouette_of_copies_and_points_far_out(spark, monkeypatch):
    from stationloom.operators import silhouette as SI
    monkeypatch.setattr(SI, "PAIRS", 64)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat([[1e6, 2.0]], 30, axis=0), rng.normal(size=(30, 2)) * 1e-3 + [1e6, 2.0], rng.normal(size=(20, 2)) + [1e6, 3.0]])
    c = np.array([0] * 30 + [1] * 30 + [2] * 20)
    df = points_frame(spark, x).withColumn("cluster", F.when(F.col("id") < 30, 0).when(F.col("id") < 60, 1).otherwise(2))
    got = {r["id"]: r["silhouette"] for r in exact_silhouette(df, "id", "v").collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(len(x)):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    # a vector is copied per block, so blocks are large
    assert SI.BLOCK_ROWS >= 20_000


def test_components_match_numpy(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1] + [100, 0, 0, 7]
    df = PR.assembler(list("abcd")).transform(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double"))
    model = PR.fit_components(df, "x", 4, "z", 0.97)
    share = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    share = share / share.sum()
    keep = int(np.argmax(np.cumsum(share) > 0.97)) + 1
    assert PR.explained(model) == pytest.approx(share[:keep].tolist())
    z = np.array([r[0] for r in PR.project(df, model).select(vector_to_array("z")).collect()])
    assert z.shape[1] == keep and np.allclose(z.mean(axis=0), 0)
    assert np.allclose(np.var(z, axis=0, ddof=1), np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:keep])


@pytest.mark.parametrize("kind, options", [("kmeans", {}), ("kmeans", {"use_pca": True, "n_init": 2}), ("gmm", {"max_iter": 3})])
def test_clusterer_round_trip_and_report(spark, stations, tmp_path, kind, options):
    model = StationClusterer(kind, **options).fit(stations, ["a", "b"])
    first = model.predict(stations)
    again = StationClusterer.load(model.save(str(tmp_path))).predict(stations)
    key = lambda f: sorted((r["row_id"], r["cluster"]) for r in f.collect())
    assert key(first) == key(again) and {c for _, c in key(first)} <= {0, 1, 2}
    tables = RP.clustering_report(stations.withColumn("type_of_area_gmap", F.col("type_of_area")), model,
                                  {0: "rural", 1: "suburban", 2: "urban"}, on_hand_labels=True)
    assert {r["against"] for r in tables["overall"].collect()} == {"type_of_area", "type_of_area_gmap"}
    assert tables["predictions"].count() == 240
    scatter = RP.cluster_scatter(stations, model)
    assert scatter["points"].count() == 240 and ("centroids" in scatter) == (kind == "kmeans" and not options)
    with pytest.raises(ValueError):
        RP.clustering_report(stations, model, None)


def test_clusterer_arguments():
    for bad in ({"model_type": "dbscan"}, {"num_clusters": 1}, {"model_type": "gmm", "covariance_type": "diag"}):
        with pytest.raises(ValueError):
            StationClusterer(**bad)
    with pytest.raises(RuntimeError):
        StationClusterer().predict(None)


@pytest.fixture(scope="module")
def ensemble(stations):
    return StationClassifier(use_smote=True, **SMALL).fit(stations)


def test_ensemble_predictions(ensemble, stations):
    out = ensemble.predict(stations)
    assert set(out.columns) == {*stations.columns, "pred_rf", "pred_catboost", "pred_lgbm", "pred_xgb", "pred_voting"}
    assert out.count() == 240 and out.select("a", "zone").subtract(stations.select("a", "zone")).isEmpty()
    known = out.where("type_of_area <> 'unknown'")
    hits = known.where("pred_voting = type_of_area").count()
    assert hits / known.count() > 0.8
    assert {r[0] for r in out.select("pred_rf").distinct().collect()} <= {"rural", "suburban", "urban"}
    probs = ensemble.predict_proba(stations).select(*[f"proba_{m}" for m in ensemble.members]).collect()
    assert all(len(p) == 3 and sum(p) == pytest.approx(1.0) for r in probs for p in r)
    sure = ensemble.threshold_predict(stations, 1.01)
    assert {r[0] for r in sure.select("pred_xgb").distinct().collect()} == {"suburban"}


def test_unseen_category_and_missing_feature(ensemble, stations):
    odd = stations.withColumn("zone", F.lit("Elsewhere")).drop("b")
    assert ensemble.predict(odd).where("pred_voting IS NULL").count() == 0
    nulls = stations.withColumn("a", F.lit(None).cast("double"))
    assert ensemble.predict(nulls).where("pred_voting IS NULL").count() == 0


def test_ensemble_storage(ensemble, stations, tmp_path):
    ensemble.save(str(tmp_path))
    for name in ("rf", "catboost", "xgb"):
        loaded = StationClassifier.load(str(tmp_path), [name])
        a = {r["row_id"]: r[1] for r in loaded.predict(stations, name).select("row_id", f"pred_{name}").collect()}
        b = {r["row_id"]: r[1] for r in ensemble.predict(stations, name).select("row_id", f"pred_{name}").collect()}
        assert a == b
        assert loaded.feature_names(name) == ["a", "b", "zone"]
    with pytest.raises(FileNotFoundError):
        StationClassifier.load(str(tmp_path), ["nothing"])


def test_importances(ensemble, stations):
    rows = ensemble.feature_importance(stations, "rf").collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert {r["feature"] for r in rows} == {"a", "b", "zone_Africa", "zone_Asia"}


def test_classifier_report_with_thresholds(ensemble, stations):
    known = stations.where("type_of_area <> 'unknown'")
    tables = RP.classifier_report(known, ensemble, apply_threshold=True)
    assert tables["thresholds"].count() == 4
    assert tables["predictions"].columns[-1] == "type_of_area_pred_voting"
    plain = RP.classifier_report(known, {"rf": ensemble.members["rf"]})
    labels = {r["label"] for r in plain["report"].collect()}
    assert {"rural", "suburban", "urban", "accuracy", "macro avg", "weighted avg"} == labels
    with pytest.raises(ValueError):
        RP.plausibility_report(known, ensemble, "a")


def test_classifier_arguments(stations):
    with pytest.raises(ValueError):
        StationClassifier(["svm"]).fit(stations)
    with pytest.raises(RuntimeError):
        StationClassifier().predict(stations)


def test_hyper_parameters_are_merged_and_translated():
    params, balanced = translate("rf", {"n_estimators": 7, "class_weight": "balanced", "min_samples_leaf": 2})
    assert params == {"numTrees": 7, "seed": 42, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "maxDepth": 30}
    assert balanced
    given = {"num_leaves": 20, "max_depth": 9, "n_estimators": 3}
    assert translate("lgbm", given)[0]["maxDepth"] == 9
    params, _ = translate("lgbm", given | {"leaf_depth": True})
    assert params["maxDepth"] == 5 and params["maxIter"] == 3
    with pytest.raises(ValueError, match="31"):
        translate("rf", {"max_depth": 31})
    params, _ = translate("lgbm", {"reg_alpha": 0.1, "reg_lambda": 1.0, "min_child_samples": 5, "num_leaves": 20})
    assert (params["l1"], params["l2"], params["minInstancesPerNode"], params["leaves"], params["minWeight"]) == (0.1, 1.0, 5, 20, 1e-3)
    whole = settings("xgb", translate("xgb", {"alpha": 0.1, "lambda": 2, "gamma": 0.2, "min_child_weight": 3, "subsample": 0.8})[0], 3, 10)
    assert (whole.l1, whole.l2, whole.min_gain, whole.min_weight, whole.row_share, whole.column_share) == (0.1, 2.0, 0.4, 3.0, 0.8, 1.0)
    assert settings("catboost", translate("catboost", {"depth": 5, "l2_leaf_reg": 5})[0], 3, 10).symmetric
    params, _ = translate("xgb", {"gamma": 0.2, "colsample_bytree": 0.8})
    assert "minInfoGain" not in params and params["summedGain"] == 0.2 and params["featureSubsetStrategy"] == "0.8" and params["maxIter"] == 500


def test_boosting_stops_early_only_on_held_rows_and_with_patience(stations):
    assert best_round([5, 4, 4.5, 4.5, 3, 3.1, 3.2, 3.3], 3) == 5 and best_round([5, 4, 4.5, 4.5, 3], 2) == 2
    assert best_round([5, 4.9, 4.8, 4.7], 2, 0.5) == 1 and best_round([3, 2, 1], 2) == 3
    given = {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.9, "early_stopping_rounds": 2}
    whole = StationClassifier(["xgb"], use_smote=False, xgb_params=given).fit(stations)
    assert len(whole.members["xgb"].model.rounds) == 12
    held = given | {"validation_fraction": 0.2, "validationTol": 100.0}
    cut = StationClassifier(["xgb"], use_smote=False, xgb_params=held).fit(stations)
    assert len(cut.members["xgb"].model.rounds) == 1
    assert cut.predict(stations, "xgb").where("pred_xgb is null").count() == 0


def test_the_queries_train_the_rounds_of_the_file():
    from stationloom.registry import models

    defaults = models.members.__defaults__ + models.classifier.__defaults__
    assert sum(d is models.PARAMETERS for d in defaults) == 2
    for name, block in models.PARAMETERS.items():
        params, _ = translate(name.removesuffix("_params"), block)
        assert "patience" not in params and (name == "rf_params" or params["maxIter"] == 1000)


def test_members_that_miss_are_fitted_together(stations, monkeypatch):
    from stationloom.registry import models as M

    fits, fit = [], StationClassifier.fit
    monkeypatch.setattr(StationClassifier, "fit", lambda self, df: fits.append(self.names) or fit(self, df))
    monkeypatch.setattr(M, "_FITTED", {})
    small = {f"{n}_params": {"n_estimators": 2, "max_depth": 2} for n in ("rf", "lgbm", "xgb")}
    assert list(M.members(stations, ["rf", "lgbm"], ("here",), parameters=small).members) == ["rf", "lgbm"]
    assert list(M.members(stations, ["xgb", "rf"], ("here",), parameters=small).members) == ["xgb", "rf"]
    assert fits == [["rf", "lgbm"], ["xgb"]]
