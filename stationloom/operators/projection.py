"""Principal components on centred vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembler(features: list[str], out: str = "x") -> VectorAssembler:
    """Feature columns as one vector."""
    return VectorAssembler(inputCols=features, outputCol=out)


def fit_components(df: DataFrame, vector: str, size: int, out: str, variance: float | None = None) -> PipelineModel:
    """Centring and projection on ``size`` components, or on as few as exceed a share of variance."""
    centre = StandardScaler(inputCol=vector, outputCol=f"{out}_centred", withMean=True, withStd=False)
    model = Pipeline(stages=[centre, PCA(k=size, inputCol=f"{out}_centred", outputCol=f"{out}_all")]).fit(df)
    keep = size
    if variance is not None:
        total = 0.0
        for keep, share in enumerate(model.stages[1].explainedVariance.toArray(), start=1):
            total += share
            if total > variance:
                break
    slicer = VectorSlicer(inputCol=f"{out}_all", outputCol=out, indices=list(range(keep)))
    return PipelineModel([*model.stages, slicer])


def explained(model: PipelineModel) -> list[float]:
    """Share of variance of each kept component."""
    shares = model.stages[1].explainedVariance.toArray()
    return [float(v) for v in shares[: len(model.stages[2].getIndices())]]


def project(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Projected vector without the intermediate columns."""
    return model.transform(df).drop(model.stages[0].getOutputCol(), model.stages[1].getOutputCol())


def as_columns(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """Vector entries as named columns."""
    values = vector_to_array(F.col(vector))
    return df.withColumns({n: values[i] for i, n in enumerate(names)}).drop(vector)
