"""Evaluation reports as tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions import voting as V
from stationloom.operators import metrics as M
from stationloom.operators import projection as PR
from stationloom.operators import rows as R
from stationloom.operators.silhouette import exact_silhouette, squared_silhouette
from stationloom.operators.summaries import axis_extent, box_by_class
from stationloom.plans.classification import StationClassifier
from stationloom.plans.clustering import StationClusterer

PRED = "type_of_area_pred"


def clustering_metrics(df: DataFrame, clusterer: StationClusterer, target: str | None = None,
                       mode: str = "squared") -> DataFrame:
    """Silhouette of the clustering, with agreement scores when a label is given.

    The silhouette is the one on squared distances, whose cost is linear; ``mode="exact"`` compares every
    point with every other on Euclidean ones.
    """
    grouped = clusterer.transform(R.with_stable_row_id(df)).persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "exact":
        values = grouped.withColumn("__values", vector_to_array("x"))
        out = exact_silhouette(values, S.ROW_ID, "__values").agg(F.avg("silhouette").alias("silhouette"))
    else:
        value = squared_silhouette(grouped)
        out = df.sparkSession.createDataFrame([(value,)], "silhouette double")
    if target is not None:
        row = M.cluster_agreement(grouped, target, "cluster").first()
        out = out.withColumns({"ari": F.lit(row["ari"]), "nmi": F.lit(row["nmi"])})
    return out


def clustering_report(
    df: DataFrame, clusterer: StationClusterer, labels_map: dict | None, on_hand_labels: bool = False
) -> dict[str, DataFrame]:
    """Tables of a clustering evaluation, once per reference label.

    ``predictions`` holds ``area_code, type_of_area, type_of_area_pred``.
    """
    predicted = R.map_clusters(clusterer.predict(df), labels_map, "cluster", PRED)
    targets = [S.TARGET]
    if on_hand_labels and "type_of_area_gmap" in df.columns:
        targets.append("type_of_area_gmap")
    sides = F.explode(F.array(*[F.struct(F.lit(t).alias("against"), F.col(t).alias("y")) for t in targets]))
    long = predicted.select(PRED, sides.alias("s")).select(PRED, "s.*")
    by = ["against"]
    labels = M.per_label(M.contingency(long, "y", PRED, by), by)
    return {
        "predictions": predicted.select(*S.present(predicted, [S.ROW_ID]), "area_code", S.TARGET, PRED),
        "overall": M.overall(labels, by).select("against", "accuracy", "balanced_accuracy"),
        "agreement": M.cluster_agreement(long, "y", PRED, by),
        "report": M.classification_report(long, "y", PRED, by=by),
        "confusion": M.contingency(long, "y", PRED, by),
    }


def feature_importance(classifier: StationClassifier, df: DataFrame, model: str) -> DataFrame:
    """Features of a member by falling importance."""
    return classifier.feature_importance(df, model)


def _as_classifier(models: StationClassifier | dict) -> StationClassifier:
    if isinstance(models, StationClassifier):
        return models
    out = StationClassifier(models=list(models), use_smote=False)
    out.members = dict(models)
    return out


def classifier_report(
    df: DataFrame, models: StationClassifier | dict, apply_threshold: bool = False, metric: str = "f1_macro"
) -> dict[str, DataFrame]:
    """Predictions of every member and the vote, and all members' metrics from one count.

    With ``apply_threshold`` each member's predictions use the threshold that scores best on
    these rows; ``thresholds`` lists them.
    """
    classifier = _as_classifier(models)
    names = list(classifier.members)
    scored = df
    for name in names:
        scored = classifier.members[name].score(scored)
    out: dict[str, DataFrame] = {}
    if apply_threshold:
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        sides = F.explode(F.array(*[
            F.struct(F.lit(n).alias("model"), F.col(f"proba_{n}").alias("proba")) for n in names]))
        long = scored.select(S.TARGET, sides.alias("s")).select(S.TARGET, "s.*")
        grid = M.threshold_scores(long, S.TARGET, F.col("proba"), metric, by=["model"])
        best = {r["model"]: (r["threshold"], r["score"]) for r in M.best_threshold(grid, ["model"]).collect()}
        scored = scored.withColumns({
            f"pred_{n}": V.confident_class_suburban_first(F.col(f"proba_{n}"), best[n][0]) for n in names})
        out["thresholds"] = df.sparkSession.createDataFrame(
            [(n, *best[n]) for n in names], "model string, threshold double, score double")
    renamed = [F.col(f"pred_{n}").alias(f"{PRED}_{n}") for n in names]
    votes = V.majority(F.array(*[f"pred_{n}" for n in names])).alias(f"{PRED}_voting")
    carried = S.present(df, [S.ROW_ID, "area_code", S.TARGET])
    out["predictions"] = scored.select(*carried, *renamed, votes)
    sides = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"{PRED}_{n}").alias("p")) for n in names]))
    long = out["predictions"].select(S.TARGET, sides.alias("s")).select(S.TARGET, "s.*")
    by = ["model"]
    labels = M.per_label(M.contingency(long, S.TARGET, "p", by), by)
    out["overall"] = M.overall(labels, by).select("model", "accuracy", "balanced_accuracy")
    out["class_accuracy"] = labels.where(F.col("support") > 0).select(
        "model", "label", F.col("recall").alias("accuracy"))
    out["report"] = M.classification_report(long, S.TARGET, "p", by=by)
    return out


def plausibility_report(
    df: DataFrame, models: StationClassifier | dict, species: str, model: str | None = None
) -> dict[str, DataFrame]:
    """Box statistics of a species per predicted class, and accuracy where labels are known."""
    if model is None:
        raise ValueError("'model' must be specified, for example 'rf'.")
    classifier = _as_classifier(models)
    predicted = classifier.predict(df, model).persist(StorageLevel.MEMORY_AND_DISK)
    out = {"box": box_by_class(predicted, species, f"pred_{model}")}
    if S.TARGET in df.columns:
        labels = M.per_label(M.contingency(predicted, S.TARGET, f"pred_{model}"))
        out["overall"] = M.overall(labels).select("accuracy")
    return out


def cluster_scatter(
    df: DataFrame, clusterer: StationClusterer, labels_map: dict | None = None, features: list[str] | None = None
) -> dict[str, DataFrame]:
    """Points and centroids in a fresh two-component projection, its variance and extent.

    When the clustering itself ran on components, its centroids live in another space and are
    left out.
    """
    spark = df.sparkSession
    features = features or clusterer.features
    grouped = clusterer.predict(R.with_stable_row_id(df))
    vectors = PR.assembler(features, "__raw").transform(grouped)
    plane: PipelineModel = PR.fit_components(vectors, "__raw", 2, "__xy")
    flat = PR.as_columns(PR.project(vectors, plane), "__xy", ["pc1", "pc2"])
    points = flat.select(S.ROW_ID, "cluster", "pc1", "pc2")
    if labels_map:
        points = R.map_clusters(points, labels_map, "cluster", "label")
    out = {
        "points": points,
        "variance": spark.createDataFrame(
            [(f"pc{i + 1}", v) for i, v in enumerate(PR.explained(plane))], "component string, share double"),
        "extent": axis_extent(points, "pc1", "pc2"),
    }
    centers = clusterer.centers()
    if centers is not None and not clusterer.use_pca:
        rows = spark.createDataFrame(
            [(i, *c) for i, c in enumerate(centers)],
            "cluster int, " + ", ".join(f"`{f}` double" for f in features))
        flat = PR.project(PR.assembler(features, "__raw").transform(rows), plane)
        out["centroids"] = PR.as_columns(flat, "__xy", ["pc1", "pc2"]).select("cluster", "pc1", "pc2")
    return out
