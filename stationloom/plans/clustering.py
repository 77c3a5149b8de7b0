"""Unsupervised grouping of stations."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel, KMeans, KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.operators import projection as PR
from stationloom.plans.state import read_json, write_json

MODELS = ("kmeans", "gmm")
PCA_VARIANCE = 0.97
SEED = 42
OPTIONS = {"n_init", "max_iter", "tol", "init", "random_state", "covariance_type"}


class StationClusterer:
    """k-means or Gaussian mixture, optionally on principal components.

    ``n_init`` restarts keep the best fit. ``max_iter`` (300 for k-means, 100 for the mixture) and ``tol``
    (1e-4 and 1e-3) end a fit, ``init="random"`` starts k-means from random points, ``random_state`` is the
    seed. Mixtures have full covariances only. Anything else is refused.
    """

    def __init__(self, model_type: str = "kmeans", num_clusters: int = 3, use_pca: bool = False, **kwargs):
        if model_type.lower() not in MODELS:
            raise ValueError(f"no clustering named {model_type!r}; there are {', '.join(MODELS)}")
        if num_clusters < 2:
            raise ValueError(f"a clustering needs two groups or more, not {num_clusters}")
        unknown = sorted(set(kwargs) - OPTIONS)
        if unknown:
            raise TypeError(f"no such clustering option: {', '.join(unknown)}")
        if kwargs.get("covariance_type", "full") != "full":
            raise ValueError("only covariance_type='full' is available")
        self.model_type, self.num_clusters, self.use_pca, self.kwargs = model_type.lower(), num_clusters, use_pca, kwargs
        self.features: list[str] | None = None
        self.model = None
        self.pca: PipelineModel | None = None

    def _require_fit(self) -> None:
        if self.model is None:
            raise RuntimeError("This clusterer is not fitted yet. Call fit() before using this method.")

    def _vectors(self, df: DataFrame) -> DataFrame:
        out = PR.assembler(self.features, "x_raw").transform(df)
        return out.withColumnRenamed("x_raw", "x") if self.pca is None else PR.project(out, self.pca).drop("x_raw")

    def _candidate(self, seed: int):
        if self.model_type == "kmeans":
            start = "random" if self.kwargs.get("init") == "random" else "k-means||"
            return KMeans(
                k=self.num_clusters, seed=seed, initMode=start, maxIter=self.kwargs.get("max_iter", 300),
                tol=self.kwargs.get("tol", 1e-4), featuresCol="x", predictionCol="cluster")
        return GaussianMixture(
            k=self.num_clusters, seed=seed, maxIter=self.kwargs.get("max_iter", 100), tol=self.kwargs.get("tol", 1e-3),
            featuresCol="x", predictionCol="cluster", probabilityCol="cluster_probability")

    def fit(self, df: DataFrame, features: list[str] | None = None) -> StationClusterer:
        """Fit on the given features, by default every column that is no identifier or label."""
        self.features = features or S.feature_columns(df)
        if self.use_pca:
            raw = PR.assembler(self.features, "x_raw").transform(df)
            self.pca = PR.fit_components(raw, "x_raw", len(self.features), "x", PCA_VARIANCE)
        vectors = self._vectors(df.select(*self.features)).select("x").persist()
        n_init = self.kwargs.get("n_init", 1)
        restarts = n_init if isinstance(n_init, int) else 1
        seed = self.kwargs.get("random_state", SEED)
        fits = [self._candidate(seed + i).fit(vectors) for i in range(restarts)]
        better = (lambda m: -m.summary.trainingCost) if self.model_type == "kmeans" else (lambda m: m.summary.logLikelihood)
        self.model = max(fits, key=better)
        vectors.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame with the vector ``x`` and an integer ``cluster``."""
        self._require_fit()
        return self.model.transform(self._vectors(df)).drop("cluster_probability")

    def predict(self, df: DataFrame) -> DataFrame:
        """The frame with an integer ``cluster``."""
        return self.transform(df).drop("x")

    def centers(self) -> list[list[float]] | None:
        """Centroids in the space the model was fitted in; only k-means has them."""
        self._require_fit()
        return [list(map(float, c)) for c in self.model.clusterCenters()] if self.model_type == "kmeans" else None

    def save(self, folder: str) -> str:
        """Store the model; gives back its folder."""
        self._require_fit()
        path = f"{folder}/{self.model_type}"
        self.model.write().overwrite().save(f"{path}/model")
        if self.pca is not None:
            self.pca.write().overwrite().save(f"{path}/pca")
        write_json(f"{path}/meta", {
            "model_type": self.model_type, "num_clusters": self.num_clusters, "use_pca": self.use_pca,
            "kwargs": self.kwargs, "features": self.features})
        return path

    @classmethod
    def load(cls, path: str) -> StationClusterer:
        """Read a stored model."""
        meta = read_json(f"{path}/meta")
        out = cls(meta["model_type"], meta["num_clusters"], meta["use_pca"], **meta["kwargs"])
        out.features = meta["features"]
        out.model = (KMeansModel if out.model_type == "kmeans" else GaussianMixtureModel).load(f"{path}/model")
        out.pca = PipelineModel.load(f"{path}/pca") if out.use_pca else None
        return out


def cluster_sizes(df: DataFrame) -> DataFrame:
    """Rows per cluster."""
    return df.groupBy("cluster").agg(F.count("*").alias("n"))
