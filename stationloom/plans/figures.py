"""The tables behind exploratory figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.operators import metrics as M
from stationloom.operators import rows as R
from stationloom.operators import summaries as A


def correlation(df: DataFrame) -> DataFrame:
    """Correlations below the diagonal over all numeric columns but the row id."""
    return A.correlations(df, [c for c in S.numeric_columns(df) if c != S.ROW_ID])


def box_per_column(df: DataFrame) -> DataFrame:
    """Box statistics of every numeric column but the row id."""
    return A.box_table(df, {c: F.col(c) for c in S.numeric_columns(df) if c != S.ROW_ID})


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Confusion matrix with the overall accuracy on every row."""
    cells = M.confusion_matrix(df, y, p)
    accuracy = M.overall(M.per_label(M.contingency(df, y, p))).first()["accuracy"]
    return cells.withColumn("accuracy", F.lit(accuracy))


def distributions(
    df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
    plot_numeric: bool = True, plot_categorical: bool = True, plot_target: bool = True, target: str = S.TARGET,
) -> dict[str, DataFrame]:
    """Histogram, density and box per numeric column, value counts per category, target counts."""
    out: dict[str, DataFrame] = {}
    if plot_numeric:
        columns = numeric or S.numeric_columns(df, S.NUMERIC)
        out["histogram"] = A.histograms(df, columns)
        out["density"] = A.kde_curves(df, columns)
        out["box"] = A.box_table(df, {c: F.col(c) for c in columns})
    if plot_categorical:
        out["categories"] = A.category_counts(df, categorical)
    if plot_target and (counts := A.target_counts(df, target)) is not None:
        out["target"] = counts
    return out


def split_points(train: DataFrame, test: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Coordinates of every station with the part it belongs to."""
    parts = [R.tagged_points(train, "train"), R.tagged_points(test, "test")]
    if validation is not None:
        parts.append(R.tagged_points(validation, "validation"))
    return R.union_all(*parts)
