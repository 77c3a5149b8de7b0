"""Queries for features, clustering, classification, scoring, reports and figure tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stationloom import fixtures as X
from stationloom import schema as S
from stationloom.fixtures import with_blocks
from stationloom.operators import metrics as M
from stationloom.operators import oversampling as O
from stationloom.operators import projection as PR
from stationloom.operators import rows as R
from stationloom.operators import sampling as SP
from stationloom.operators import summaries as A
from stationloom.operators.silhouette import exact_silhouette, squared_silhouette
from stationloom.plans import figures as G
from stationloom.plans import reports as RP
from stationloom.plans import scoring as SC
from stationloom.plans.classification import StationClassifier
from stationloom.plans.cleaning import StationCleaner, StationCleanerModel
from stationloom.plans.clustering import StationClusterer, cluster_sizes
from stationloom.plans.features import FeatureEngineer, FeatureEngineerModel
from stationloom.plans.refresh import refresh
from stationloom.registry.base import NUMERIC_HERE, over_clean, query
from stationloom.registry.rows import MEMBERS, clean, species
from stationloom.registry.tables import (
    _CM, _DISTRIBUTION, _SPLIT_CTES, _box_sql, _corr_sql, _parts, report_parts, report_sql, rounded,
)
from stationloom.session import scratch_path
from stationloom.sources import csv_files, sinks
from stationloom.sources.parameters import load_parameters

# The settings of the members in the parameter file that ships with the task.
PARAMETERS = {
    "rf_params": {
        "n_estimators": 500, "criterion": "gini", "class_weight": "balanced", "max_depth": 12, "min_samples_split": 5,
        "min_samples_leaf": 2, "max_features": "sqrt", "bootstrap": True, "n_jobs": -1, "random_state": 42,
    },
    "catboost_params": {
        "iterations": 1000, "learning_rate": 0.05, "depth": 5, "loss_function": "MultiClass", "eval_metric": "TotalF1",
        "auto_class_weights": "Balanced", "l2_leaf_reg": 5, "early_stopping_rounds": 50, "random_seed": 42, "verbose": 100,
    },
    "lgbm_params": {
        "objective": "multiclass", "num_class": 3, "learning_rate": 0.05, "n_estimators": 1000, "class_weight": "balanced",
        "max_depth": 5, "num_leaves": 20, "min_child_samples": 5, "subsample": 0.8, "colsample_bytree": 0.8,
        "reg_alpha": 0.1, "reg_lambda": 1.0, "random_state": 42, "n_jobs": -1,
    },
    "xgb_params": {
        "objective": "multi:softprob", "num_class": 3, "learning_rate": 0.05, "n_estimators": 1000, "max_depth": 4,
        "min_child_weight": 3, "subsample": 0.8, "colsample_bytree": 0.8, "gamma": 0.2, "alpha": 0.1, "lambda": 1.0,
        "tree_method": "hist", "enable_categorical": True, "random_state": 42, "n_jobs": -1,
    },
}
# End of fixed values.
CATS = ["timezone", "climatic_zone_year2016"]
_REGIONS_HERE = ["Africa", "America", "Asia", "Europe", "nan"]


def imputed(spark, d):
    """Cleaned stations, numbers filled by means."""
    return StationCleaner(imputer="mean").fit_transform(X.stations_raw(spark, d))[1]


def features(spark, d, **options):
    """Feature frame with a standard scaling."""
    base = imputed(spark, d).select(S.ROW_ID, *S.ID_COLUMNS, S.TARGET, *NUMERIC_HERE, *CATS)
    return FeatureEngineer(scaling="standard", **options).fit_transform(base)


def numeric_features(spark, d):
    return features(spark, d)[1].drop(*CATS)


_FITTED: dict = {}


def members(df, names, key, smote=False, parameters=PARAMETERS):
    """A classifier of fully sized members. Each is fitted once per session, folder and kind of features,
    and shared by the queries; those that miss are fitted together, on the same prepared rows."""
    out = StationClassifier(names, use_smote=smote, **parameters)
    own = {n: (df.sparkSession.sparkContext.applicationId, *key, smote, n, str(parameters[f"{n}_params"])) for n in out.names}
    missing = [n for n in out.names if own[n] not in _FITTED]
    if missing:
        fitted = StationClassifier(missing, use_smote=smote, **parameters).fit(df).members
        _FITTED.update({own[n]: fitted[n] for n in missing})
    out.members.update({n: _FITTED[own[n]] for n in out.names})
    return out


def classifier(spark, d, models=None, numeric_only=False, smote=False, parameters=PARAMETERS):
    df = numeric_features(spark, d) if numeric_only else features(spark, d)[1]
    return df, members(df, models, (d, numeric_only), smote, parameters)


# Labels follow from one feature, so members that learnt it predict this for every row, labelled or not.
LEARNT = "CASE WHEN mean_stable_nightlights_5km_year2013 >= 12 THEN 'urban' WHEN mean_stable_nightlights_5km_year2013 >= 8 THEN 'suburban' ELSE 'rural' END"


def vectors(spark, d):
    return X.table(spark, d, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("x"))


def clustered(spark, d, kind="kmeans", **options):
    df = numeric_features(spark, d)
    return df, StationClusterer(kind, **options).fit(df, NUMERIC_HERE)


def _ref(c):
    return f"(SELECT avg({c}) FROM structural)"


def over_kept(body, **extra):
    """SQL over the rows that cleaning with mean imputation keeps."""
    return over_clean(body, upto="structural", kept=f"""
SELECT row_id, area_code, coalesce(timezone, 'nan') AS timezone, type_of_area, {LEARNT} AS learnt FROM structural
WHERE coalesce({S.ROAD}, {_ref(S.ROAD)}) >= 0""", **extra)


# -- C: feature composites ----------------------------------------------------------------


@query("c6_feature_fit", over_clean(f"""
SELECT row_id, round((altitude - (SELECT avg(altitude) FROM filled)) / (SELECT stddev_pop(altitude) FROM filled), 5) AS altitude,
  CASE WHEN timezone = 'Africa' THEN 0 WHEN timezone = 'America' THEN 1 WHEN timezone = 'Asia' THEN 2
    WHEN timezone = 'Europe' THEN 3 ELSE 4 END AS timezone FROM filled""", upto="structural",
    filled=f"""SELECT row_id, coalesce(altitude, {_ref('altitude')}) AS altitude, coalesce(timezone, 'nan') AS timezone
      FROM structural WHERE coalesce({S.ROAD}, {_ref(S.ROAD)}) >= 0"""))
def c6(spark, d):
    base = imputed(spark, d).select(S.ROW_ID, "altitude", "timezone")
    model = FeatureEngineer(
        scaling="standard", handle_skewness=False, encoder="le", encode=["timezone"]).fit(base)
    return rounded(model.transform(base), 5)


def _capped_sql(c):
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    lo = f"(SELECT {q1} - 1.5 * ({q3} - {q1}) FROM cleaned)"
    hi = f"(SELECT {q3} + 1.5 * ({q3} - {q1}) FROM cleaned)"
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS {c}"


@query("c7_feature_transform", over_clean(
    "SELECT row_id, " + ", ".join(
        f"round(({c} - (SELECT min({c}) FROM capped)) / (SELECT max({c}) - min({c}) FROM capped), 6) AS {c}"
        for c in ("altitude", S.ROAD)) + ", "
    + ", ".join(f"CASE WHEN timezone = '{r}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS timezone_{r}" for r in _REGIONS_HERE[1:])
    + " FROM capped", capped=f"SELECT row_id, timezone, {_capped_sql('altitude')}, {_capped_sql(S.ROAD)} FROM cleaned"))
def c7(spark, d):
    base = clean(spark, d).select(S.ROW_ID, "altitude", S.ROAD, "timezone")
    model = FeatureEngineer(
        cap_outliers=True, handle_skewness=False, scaling="minmax", encoder="ohe", encode=["timezone"]).fit(base)
    return rounded(model.transform(base))


@query("c7_feature_transform_full")
def c7_full(spark, d):
    base = imputed(spark, d)
    model = FeatureEngineer(cap_outliers=True, scaling="robust", encoder="ohe", encode=CATS).fit(base)
    return model.transform(base)


@query("c8_feature_fit_transform", over_kept("SELECT row_id, type_of_area, " + ", ".join(
    f"CASE WHEN timezone = '{r}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS timezone_{r}" for r in _REGIONS_HERE[1:])
    + " FROM kept"))
def c8(spark, d):
    df = features(spark, d, encoder="ohe", encode=["timezone"])[1]
    return df.select(S.ROW_ID, S.TARGET, *[c for c in df.columns if c.startswith("timezone_")])


@query("c9_feature_options", over_clean("SELECT row_id, lat, lon, altitude, timezone FROM cleaned"))
def c9(spark, d):
    model = FeatureEngineer(selected=["altitude", "timezone"], scale_features=False, handle_skewness=False,
                            encode_categories=False).fit(clean(spark, d))
    return model.transform(clean(spark, d))


@query("x5_categorical_features", over_clean("SELECT row_id, timezone, climatic_zone_year2016 FROM tidy", tidy="""
SELECT row_id, timezone, regexp_replace(climatic_zone_year2016, '\\.0$', '') AS climatic_zone_year2016 FROM cleaned"""))
def x5(spark, d):
    model = FeatureEngineer(handle_skewness=False).fit(clean(spark, d))
    return model.transform(clean(spark, d)).select(S.ROW_ID, *CATS)


@query("l10_encoding_off", over_clean("SELECT row_id, timezone FROM cleaned"))
def l10(spark, d):
    model = FeatureEngineer(encoder="ohe", encode=["timezone"], encode_categories=False, handle_skewness=False)
    return model.fit(clean(spark, d)).transform(clean(spark, d)).select(S.ROW_ID, "timezone")


@query("l15_scale_all", over_clean(f"""
SELECT row_id, round((altitude - (SELECT min(altitude) FROM cleaned)) / (SELECT max(altitude) - min(altitude) FROM cleaned), 6) AS altitude,
  round(({S.ROAD} - (SELECT min({S.ROAD}) FROM cleaned)) / (SELECT max({S.ROAD}) - min({S.ROAD}) FROM cleaned), 6) AS {S.ROAD} FROM cleaned"""))
def l15(spark, d):
    base = clean(spark, d).select(S.ROW_ID, "altitude", S.ROAD, S.TARGET)
    model = FeatureEngineer(scaling="minmax", scale_only="all", handle_skewness=False).fit(base)
    return rounded(model.transform(base).drop(S.TARGET))


@query("s14_cleaner_round_trip", over_clean("SELECT row_id, area_code FROM cleaned"))
def s14(spark, d):
    raw, path = X.stations_raw(spark, d), scratch_path(spark, "cleaner")
    StationCleaner(impute=False).fit(raw).store(path)
    return StationCleanerModel.restore(path).transform(raw).select(S.ROW_ID, "area_code")


@query("s14_learned_state_round_trip", over_clean(
    "SELECT row_id, " + ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM structural)), 4) AS {c}" for c in NUMERIC_HERE)
    + f" FROM structural WHERE coalesce({S.ROAD}, (SELECT avg({S.ROAD}) FROM structural)) >= 0", upto="structural"))
def s14b(spark, d):
    raw, path = X.stations_raw(spark, d), scratch_path(spark, "cleaner")
    StationCleaner(imputer="mean").fit(raw.limit(20)).store(path)
    StationCleaner(imputer="mean").fit(raw).store(path)
    out = StationCleanerModel.restore(path).transform(raw)
    return out.select(S.ROW_ID, *[F.round(c, 4).alias(c) for c in NUMERIC_HERE])


@query("s15_features_round_trip", over_clean("SELECT row_id, " + ", ".join(
    f"round(({c} - (SELECT median({c}) FROM cleaned)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM cleaned), 6) AS {c}"
    for c in NUMERIC_HERE) + " FROM cleaned"))
def s15(spark, d):
    base, path = clean(spark, d), scratch_path(spark, "features")
    FeatureEngineer(scaling="robust", handle_skewness=False).fit(base).store(path)
    return rounded(FeatureEngineerModel.restore(path).transform(base).select(S.ROW_ID, *NUMERIC_HERE))


# -- L, M, E5: projection and clustering ---------------------------------------------------


@query("l16_components_by_variance")
def l16(spark, d):
    df = vectors(spark, d)
    model = PR.fit_components(df, "x", 64, "z", 0.97)
    return PR.project(df, model).select("vec_id", vector_to_array("z").alias("z"))


@query("l17_plane_projection")
def l17(spark, d):
    df = vectors(spark, d)
    return PR.as_columns(PR.project(df, PR.fit_components(df, "x", 2, "xy")), "xy", ["pc1", "pc2"]).select(
        "vec_id", "pc1", "pc2")


@query("m1_kmeans")
def m1(spark, d):
    df, model = clustered(spark, d)
    return cluster_sizes(model.predict(df))


@query("m2_gaussian_mixture")
def m2(spark, d):
    df, model = clustered(spark, d, "gmm")
    return cluster_sizes(model.predict(df))


@query("m3_assignment_with_pca", over_kept("SELECT row_id, true AS assigned FROM kept"))
def m3(spark, d):
    df, model = clustered(spark, d, use_pca=True)
    return model.predict(df).select(S.ROW_ID, F.col("cluster").between(0, 2).alias("assigned"))


def _same(a, b, column):
    """Whether two results agree, row by row."""
    other = b.select(S.ROW_ID, F.col(column).alias("other"))
    return a.join(other, S.ROW_ID).select(S.ROW_ID, F.col(column).eqNullSafe(F.col("other")).alias("same"))


@query("s16_clusterer_round_trip", over_kept("SELECT row_id, true AS same FROM kept"))
def s16(spark, d):
    df, model = clustered(spark, d, use_pca=True)
    stored = StationClusterer.load(model.save(scratch_path(spark, "clusters")))
    return _same(model.predict(df), stored.predict(df), "cluster")


@query("e5_silhouette_exact", """
WITH s AS (SELECT a.vec_id, a.label AS own, b.label AS c,
    sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
n AS (SELECT label, count(*) AS m FROM embeddings GROUP BY 1),
v AS (SELECT vec_id, own, max(s) FILTER (WHERE own = c) / (any_value(o.m) - 1) AS a, min(s / n.m) FILTER (WHERE own <> c) AS b
  FROM s JOIN n ON n.label = c JOIN n o ON o.label = own GROUP BY 1, 2)
SELECT vec_id, own AS label, round((b - a) / greatest(a, b), 6) AS silhouette FROM v""")
def e5(spark, d):
    return rounded(exact_silhouette(X.table(spark, d, "embeddings"), "vec_id", "embedding", "label"))


@query("e5_silhouette_squared", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(pow(list_distance(a.v, b.v), 2)) AS s FROM e a, e b GROUP BY 1, 2, 3),
n AS (SELECT label, count(*) AS m FROM e GROUP BY 1),
v AS (SELECT vec_id, own, max(s) FILTER (WHERE own = c) / (any_value(o.m) - 1) AS a, min(s / n.m) FILTER (WHERE own <> c) AS b
  FROM s JOIN n ON n.label = c JOIN n o ON o.label = own GROUP BY 1, 2)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM v""")
def e5b(spark, d):
    value = squared_silhouette(vectors(spark, d), "x", "label")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query("e5_clustering_metrics")
def e5c(spark, d):
    df, model = clustered(spark, d)
    return RP.clustering_metrics(df, model, S.TARGET)


def _map(model):
    return {i: S.CLASSES[i % 3] for i in range(model.num_clusters)}


@query("e6_clustering_report")
def e6(spark, d):
    df, model = clustered(spark, d)
    return RP.clustering_report(df, model, _map(model))["report"]


@query("e6_clustering_predictions", over_kept("SELECT area_code, type_of_area, true AS named FROM kept"))
def e6b(spark, d):
    df, model = clustered(spark, d)
    found = RP.clustering_report(df, model, _map(model))["predictions"]
    return found.select("area_code", S.TARGET, F.col(RP.PRED).isin(S.CLASSES).alias("named"))


@query("e6_hand_label_report", report_sql("type_of_area_source", "type_of_area_gmap", "hand_labels", "hand_labels"))
def e6c(spark, d):
    return M.classification_report(X.hand_labels(spark, d), "type_of_area_source", "type_of_area_gmap")


# -- R4, M4-M14: classification -------------------------------------------------------------

_SYNTHETIC = """
SELECT type_of_area, (SELECT max(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY type_of_area) q) AS n
FROM labelled GROUP BY 1"""


@query("r4_oversampled_counts", over_kept(_SYNTHETIC, labelled="SELECT type_of_area FROM kept WHERE type_of_area <> 'unknown'"))
def r4(spark, d):
    labelled = R.split_labelled(numeric_features(spark, d))[0]
    return O.oversample(labelled, NUMERIC_HERE).groupBy(S.TARGET).agg(F.count("*").alias("n"))


@query("r4_nearest_neighbours", """
SELECT vec_id, round(d, 6) AS dist5 FROM (
  SELECT a.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS place
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) q WHERE place = 5""")
def r4b(spark, d):
    points = X.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    near = O.nearest_neighbours(points, 5, block_rows=200)
    gap = F.sqrt(F.aggregate(F.zip_with("v", F.col("near")[4], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return points.join(near, "v").select(F.col("id").alias("vec_id"), F.round(gap, 6).alias("dist5"))


def _member(name):
    def run(spark, d):
        df, model = classifier(spark, d, [name])
        return model.predict(df, name).groupBy(S.TARGET, f"pred_{name}").agg(F.count("*").alias("n"))
    return run


for _i, _name in enumerate(MEMBERS):
    query(f"m{4 + _i}_{_name}_member", over_kept(
        f"SELECT type_of_area, learnt AS pred_{_name}, count(*) AS n FROM kept GROUP BY 1, 2"))(_member(_name))


@query("m8_all_members_smote", over_kept(
    "SELECT row_id, " + ", ".join(f"learnt AS {c}" for c in SC.output_columns(MEMBERS)) + " FROM kept"))
def m8(spark, d):
    df, model = classifier(spark, d, numeric_only=True, smote=True)
    return model.predict(df).select(S.ROW_ID, *SC.output_columns(MEMBERS))


def parameter_file(spark, blocks):
    """A parameter file in the shared folder, as a user would write it."""
    import yaml

    path = scratch_path(spark, "parameters")
    spark.range(1).select(F.lit(yaml.safe_dump(blocks, sort_keys=False)).alias("value")).write.text(path)
    return path


@query("m9_parameter_translation", over_kept("""
SELECT learnt AS pred_xgb, count(*) AS n, true AS later_trees_split FROM kept GROUP BY 1"""))
def m9(spark, d):
    # The file's own blocks; the summed-loss parameter among them must not keep later trees from splitting.
    blocks = load_parameters(spark, parameter_file(spark, PARAMETERS))
    df, model = classifier(spark, d, ["xgb"], parameters=blocks)
    split = all(max(t.feature) >= 0 for t in model.members["xgb"].model.rounds[5])
    return model.predict(df, "xgb").groupBy("pred_xgb").agg(F.count("*").alias("n")).withColumn("later_trees_split", F.lit(split))


@query("m10_predict_and_vote", over_kept("SELECT row_id, learnt AS pred_rf, learnt AS pred_lgbm, learnt AS pred_voting FROM kept"))
def m10(spark, d):
    df, model = classifier(spark, d, ["rf", "lgbm"])
    return model.predict(df).select(S.ROW_ID, *SC.output_columns(["rf", "lgbm"]))


@query("m11_probabilities", over_kept("SELECT row_id, 1.0 AS rf, 1.0 AS xgb, learnt AS top_rf, learnt AS top_xgb FROM kept"))
def m11(spark, d):
    df, model = classifier(spark, d, ["rf", "xgb"])
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, p: s + p), 9)
    classes = F.array(*[F.lit(c) for c in sorted(S.CLASSES)])
    top = lambda c: F.element_at(classes, F.array_position(c, F.array_max(c)).cast("int"))
    return model.predict_proba(df).select(
        S.ROW_ID, total("proba_rf").alias("rf"), total("proba_xgb").alias("xgb"),
        top("proba_rf").alias("top_rf"), top("proba_xgb").alias("top_xgb"))


@query("m12_member_thresholds", over_kept("SELECT row_id, learnt AS pred_xgb, 'suburban' AS beyond_reach FROM kept"))
def m12b(spark, d):
    df, model = classifier(spark, d, ["xgb"])
    strict = model.threshold_predict(df, 1.01).select(S.ROW_ID, F.col("pred_xgb").alias("beyond_reach"))
    return model.threshold_predict(df, 0.5).select(S.ROW_ID, "pred_xgb").join(strict, S.ROW_ID)


@query("m14_feature_names", over_kept(" UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS feature, count(*) AS n FROM kept" for i, c in enumerate([*NUMERIC_HERE, *CATS]))))
def m14(spark, d):
    df, model = classifier(spark, d, ["rf"])
    named = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature")) for i, c in enumerate(model.feature_names("rf"))]
    return df.select(F.inline(F.array(*named))).groupBy("place", "feature").agg(F.count("*").alias("n"))


@query("s17_classifier_round_trip", over_kept("SELECT row_id, learnt AS pred_catboost FROM kept"))
def s17(spark, d):
    df, model = classifier(spark, d, ["rf", "catboost"])
    path = scratch_path(spark, "members")
    model.save(path)
    stored = StationClassifier.load(path, ["catboost"])
    return stored.predict(df, "catboost").select(S.ROW_ID, "pred_catboost")


@query("s19_parameter_file", over_kept("SELECT row_id, learnt AS pred_rf, learnt AS pred_lgbm FROM kept"))
def s19(spark, d):
    blocks = load_parameters(spark, parameter_file(spark, PARAMETERS))
    df, model = classifier(spark, d, ["rf", "lgbm"], parameters=blocks)
    return model.predict(df).select(S.ROW_ID, "pred_rf", "pred_lgbm")


@query("e7_feature_importance")
def e7(spark, d):
    df, model = classifier(spark, d, ["rf"])
    return RP.feature_importance(model, df, "rf")


@query("t1_importance_order")
def t1(spark, d):
    df, model = classifier(spark, d, ["lgbm"], numeric_only=True)
    return RP.feature_importance(model, df, "lgbm")


_E9_BODY, _E9_STEPS = report_parts("type_of_area", "learnt", "scored", by="model")


@query("e9_classifier_report", over_kept(_E9_BODY, scored="""
SELECT model, type_of_area, learnt FROM kept, (VALUES ('rf'), ('lgbm')) m(model) WHERE type_of_area <> 'unknown'""", **_E9_STEPS))
def e9(spark, d):
    df, model = classifier(spark, d, ["rf", "lgbm"])
    return RP.classifier_report(R.split_labelled(df)[0], model)["report"]


@query("e9_thresholded_predictions", over_kept(
    "SELECT row_id, area_code, type_of_area, " + ", ".join(f"learnt AS type_of_area_pred_{n}" for n in ("rf", "xgb", "voting"))
    + " FROM kept WHERE type_of_area <> 'unknown'"))
def e9b(spark, d):
    df, model = classifier(spark, d, ["rf", "xgb"])
    return RP.classifier_report(R.split_labelled(df)[0], model, apply_threshold=True)["predictions"]


@query("e10_plausibility")
def e10(spark, d):
    df, model = classifier(spark, d, ["rf"])
    return RP.plausibility_report(R.join_on_keys(df, species(spark, d)[0]), model, "no2", "rf")["box"]


# -- S18, C10-C13: scoring ------------------------------------------------------------------


def artifacts(spark, d, models):
    """Folder with a stored cleaner, feature preparation and classifier."""
    raw = X.stations_raw(spark, d)
    cleaner, cleaned = StationCleaner(imputer="mean").fit_transform(raw)
    prep, df = FeatureEngineer(selected=["area_code", S.TARGET, *NUMERIC_HERE, *CATS], scaling="standard").fit_transform(cleaned)
    folder = scratch_path(spark, "artifacts")
    SC.save_artifacts(folder, cleaner, prep, members(df, models, (d, False)))
    return folder


_SCORED = """
SELECT s.lat, s.lon, s.area_code, s.type_of_area, coalesce(k.learnt, 'not enough data for prediction') AS pred
FROM stations_raw s LEFT JOIN kept k ON s.row_id = k.row_id"""


@query("s18_load_artifacts", over_kept(f"SELECT pred AS pred_rf, count(*) AS n FROM ({_SCORED}) q GROUP BY 1"))
def s18(spark, d):
    scorer = SC.BatchScorer(spark, artifacts(spark, d, ["rf"]), best_model="rf")
    return scorer.predict(X.stations_raw(spark, d)).groupBy("pred_rf").agg(F.count("*").alias("n"))


@query("s12_exported_predictions", over_kept(f"SELECT area_code, type_of_area, pred AS pred_rf FROM ({_SCORED}) q"))
def s12b(spark, d):
    scored = SC.BatchScorer(spark, artifacts(spark, d, ["rf"]), best_model="rf").predict(X.stations_raw(spark, d))
    path = scratch_path(spark, "predictions")
    sinks.write_parquet(scored.select("area_code", S.TARGET, "pred_rf"), path, ["pred_rf"])
    return spark.read.parquet(path).select("area_code", S.TARGET, "pred_rf")


@query("c10_preprocess_for_scoring", over_kept("SELECT row_id, area_code, type_of_area, timezone FROM kept"))
def c10(spark, d):
    scorer = SC.BatchScorer(spark, artifacts(spark, d, ["rf"]))
    return scorer.preprocess(X.stations_raw(spark, d)).select(S.ROW_ID, "area_code", S.TARGET, "timezone")


@query("c11_score_table", over_kept(
    f"SELECT lat, lon, area_code, type_of_area, pred AS pred_rf, pred AS pred_lgbm, pred AS pred_voting FROM ({_SCORED}) q"))
def c11(spark, d):
    return SC.BatchScorer(spark, artifacts(spark, d, ["rf", "lgbm"])).predict(X.stations_raw(spark, d))


@query("c11_scored_rows", over_kept("""
SELECT s.lat, s.lon, s.area_code, s.type_of_area, CASE WHEN k.row_id IS NULL THEN 'not enough data for prediction'
  ELSE 'a class' END AS outcome FROM stations_raw s LEFT JOIN kept k ON s.row_id = k.row_id"""))
def c11_rows(spark, d):
    scorer = SC.BatchScorer(spark, artifacts(spark, d, ["rf"]), best_model="voting")
    pred = F.col("pred_voting")
    outcome = F.when(pred.isin(S.CLASSES), "a class").otherwise(pred)
    return scorer.predict(X.stations_raw(spark, d)).select(*S.ID_COLUMNS, S.TARGET, outcome.alias("outcome"))


@query("c12_score_as_dicts", over_kept(f"SELECT area_code, type_of_area, pred AS pred_voting FROM ({_SCORED}) q"))
def c12(spark, d):
    scorer = SC.BatchScorer(spark, artifacts(spark, d, ["rf"]), best_model="voting", output_format="dicts")
    objects = scorer.predict(X.stations_raw(spark, d))
    field = lambda c: F.get_json_object(objects.columns[0], f"$.{c}").alias(c)
    return objects.select(*[field(c) for c in ("area_code", S.TARGET, "pred_voting")])


@query("c2_cleaner_state", over_clean(" UNION ALL ".join(
    f"SELECT '{c}' AS name, round(avg({c}), 4) AS mean FROM structural" for c in NUMERIC_HERE), upto="structural"))
def c2(spark, d):
    model = StationCleaner(imputer="mean").fit(X.stations_raw(spark, d))
    return rounded(spark.createDataFrame(sorted(model.learned["means"].items()), "name string, mean double"), 4)


@query("c13_refresh", with_blocks(
    "SELECT area_code, type_of_area, climatic_zone_year2016 FROM flat", "api_records",
    flat="""SELECT json_extract_string(body, '$.codes[0]') AS area_code, json_extract_string(body, '$.type_of_area') AS type_of_area,
      json_extract_string(body, '$.globalmeta.climatic_zone_year2016') AS climatic_zone_year2016 FROM api_records
      WHERE json_extract(body, '$.coordinates') IS NOT NULL AND json_extract(body, '$.codes[0]') IS NOT NULL"""))
def c13(spark, d):
    from stationloom.registry.tables import write_pages
    url, size, n_pages = write_pages(spark, d)
    path, _ = refresh(spark, scratch_path(spark, "refresh"), url, size, n_pages)
    return csv_files.read_csv(spark, path, S.STATION_SCHEMA).select("area_code", S.TARGET, "climatic_zone_year2016")


# -- G: figure tables -----------------------------------------------------------------------


@query("g1_correlation", _corr_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem"))
def g1(spark, d):
    return rounded(G.correlation(X.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")))


@query("g2_box_per_column", " UNION ALL ".join(_box_sql(c, "part") for c in ("p_size", "p_retailprice")))
def g2(spark, d):
    df = X.table(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(G.box_per_column(df))


@query("g3_confusion", with_blocks(
    "SELECT c.*, round((SELECT avg(CASE WHEN type_of_area = pred_xgb THEN 1.0 ELSE 0 END) FROM model_votes), 6) AS accuracy "
    f"FROM ({_CM}) c", "model_votes"))
def g3(spark, d):
    return rounded(G.confusion(X.model_votes(spark, d), S.TARGET, "pred_xgb"))


def _bins_sql(c):
    return f"""
SELECT '{c}' AS "column", CAST(b.range AS INT) AS bin, round(lo + b.range * ((hi - lo) / 10), 6) AS "left",
  round(lo + (b.range + 1) * ((hi - lo) / 10), 6) AS "right", coalesce(n, 0) AS n
FROM range(10) b CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi FROM cleaned) r LEFT JOIN (
  SELECT CAST(least(floor(({c} - lo) * 10.0 / (hi - lo)), 9) AS INT) AS bin, count(*) AS n
  FROM cleaned, (SELECT min({c}) AS lo, max({c}) AS hi FROM cleaned) q WHERE {c} IS NOT NULL GROUP BY 1) h ON h.bin = b.range"""


@query("g4_histograms", over_clean(" UNION ALL ".join(_bins_sql(c) for c in NUMERIC_HERE)))
def g4(spark, d):
    return rounded(G.distributions(clean(spark, d), plot_categorical=False, plot_target=False)["histogram"])


@query("g4_categories", over_clean(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM cleaned GROUP BY {c}"
    for c in ("timezone", "type_of_area", "climatic_zone_year2016", S.LANDCOVER))))
def g4b(spark, d):
    return G.distributions(clean(spark, d), plot_numeric=False, plot_target=False)["categories"]


@query("g5_cluster_scatter")
def g5(spark, d):
    df, model = clustered(spark, d)
    return RP.cluster_scatter(df, model, _map(model))["points"]


@query("g5_plane_variance", """
SELECT vec_id, true AS inside FROM embeddings""")
def g5c(spark, d):
    df = vectors(spark, d)
    flat = PR.as_columns(PR.project(df, PR.fit_components(df, "x", 2, "xy")), "xy", ["pc1", "pc2"])
    centre = X.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    means = [r["m"] for r in centre.groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]
    spread = F.aggregate(
        F.zip_with(F.col("embedding").cast("array<double>"), F.array(*[F.lit(m) for m in means]), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0), lambda s, v: s + v)
    norms = X.table(spark, d, "embeddings").select("vec_id", spread.alias("norm"))
    inside = F.col("pc1") * F.col("pc1") + F.col("pc2") * F.col("pc2") <= F.col("norm") + 1e-6
    return flat.join(norms, "vec_id").select("vec_id", inside.alias("inside"))


@query("g5_cluster_centroids")
def g5b(spark, d):
    df, model = clustered(spark, d)
    return RP.cluster_scatter(df, model, _map(model))["centroids"]


@query("g6_importance_bars")
def g6(spark, d):
    df, model = classifier(spark, d, ["catboost"])
    return RP.feature_importance(model, df, "catboost")


@query("g7_split_counts", _DISTRIBUTION)
def g7(spark, d):
    return A.split_distribution(*_parts(spark, d))


@query("g8_split_points", over_clean("""
SELECT lat, lon, 'test' AS split FROM cleaned WHERE row_id IN (SELECT row_id FROM test_part)
UNION ALL SELECT lat, lon, 'train' FROM labelled WHERE row_id NOT IN (SELECT row_id FROM test_part)
UNION ALL SELECT lat, lon, 'validation' FROM cleaned WHERE type_of_area = 'unknown'""", **_SPLIT_CTES))
def g8(spark, d):
    train, test, _ = SP.split_for_training(clean(spark, d), labelled_only=True)
    return G.split_points(train, test, R.split_labelled(clean(spark, d))[1])
