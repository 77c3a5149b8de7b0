"""Scores computed from one contingency table.

The data is read once, by ``groupBy(true, predicted).count()``; everything after that
works on the small result and never looks at rows again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions import voting as V

METRICS = ("f1_macro", "balanced_accuracy")


def contingency(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Counts ``n`` per true label ``y`` and prediction ``p``."""
    by = by or []
    return df.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, y: str, p: str, classes: list[str] = S.CLASSES) -> DataFrame:
    """One row per true class, one column per predicted class, absent pairs as 0."""
    cells = [
        F.sum(F.when(F.col("p").eqNullSafe(F.lit(c)), F.col("n")).otherwise(0)).alias(f"pred_{c}")
        for c in classes
    ]
    return contingency(df, y, p).groupBy("y").agg(*cells)


def per_label(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits, predictions and support per label, then precision, recall and F1 (0 when undefined)."""
    by = by or []
    hit = F.when(F.col("y").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("p").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    sums = (
        table.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return sums.withColumns({
        "precision": share(F.col("hits"), F.col("predicted")),
        "recall": share(F.col("hits"), F.col("support")),
        "f1": share(2 * F.col("hits"), F.col("support") + F.col("predicted")),
    })


def overall(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted averages from the per-label table."""
    by = by or []
    n = F.sum("support")
    averages = [
        expr.alias(f"{kind}_{m}")
        for m in ("precision", "recall", "f1")
        for kind, expr in (("macro", F.avg(m)), ("weighted", F.sum(F.col(m) * F.col("support")) / n))
    ]
    return labels.groupBy(*by).agg(
        n.alias("support"),
        (F.sum("hits") / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *averages,
    )


def classification_report(df: DataFrame, y: str, p: str, digits: int = 4, by: list[str] | None = None) -> DataFrame:
    """The usual report as rows: one per label, then accuracy, macro and weighted average.

    Label rows and totals are two grouping sets of one small aggregate.
    """
    by = by or []
    labels = per_label(contingency(df, y, p, by), by)
    keys = [F.col(c) for c in by]
    scores = ["precision", "recall", "f1"]
    n = F.sum("support")
    both = labels.groupingSets([[*keys, F.col("label")], keys], *keys, F.col("label")).agg(
        n.alias("support"), (F.sum("hits") / F.when(n > 0, n)).alias("accuracy"), F.grouping("label").alias("total"),
        *[F.avg(m).alias(m) for m in scores],
        *[(F.sum(F.col(m) * F.col("support")) / F.when(n > 0, n)).alias(f"weighted_{m}") for m in scores],
    )
    null = F.lit(None).cast("double")

    def line(label: Column, *values: Column) -> Column:
        cells = [F.round(v, digits).alias(m) for m, v in zip(scores, values, strict=True)]
        return F.struct(label.alias("label"), *cells, F.col("support"))

    plain = [F.col(m) for m in scores]
    lines = F.when(F.col("total") == 0, F.array(line(F.col("label"), *plain))).otherwise(F.array(
        line(F.lit("accuracy"), null, null, F.col("accuracy")), line(F.lit("macro avg"), *plain),
        line(F.lit("weighted avg"), *[F.col(f"weighted_{m}") for m in scores])))
    return both.select(*by, F.inline(lines))


def class_accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Share of hits on each true class."""
    labels = per_label(contingency(df, y, p)).where(F.col("support") > 0)
    return labels.select("label", F.col("recall").alias("accuracy"), "support")


def cluster_agreement(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index and normalised mutual information.

    The margins come from grouping sets over the contingency table, so no join is needed.
    """
    by = by or []
    table = contingency(df, y, p, by)
    keys = [F.col(c) for c in by]
    sets = table.groupingSets(
        [[*keys, F.col("y"), F.col("p")], [*keys, F.col("y")], [*keys, F.col("p")], keys],
        *keys, F.col("y"), F.col("p"),
    ).agg(
        F.sum("n").cast("double").alias("m"),
        (F.grouping("y").cast("int") * 2 + F.grouping("p").cast("int")).alias("level"),
    )
    m = F.col("m")
    pairs = lambda lv: F.sum(F.when(F.col("level") == lv, m * (m - 1) / 2).otherwise(0.0))
    m_log_m = lambda lv: F.sum(F.when(F.col("level") == lv, m * F.log(m)).otherwise(0.0))
    sums = sets.groupBy(*by).agg(
        pairs(0).alias("cells"), pairs(1).alias("rows"), pairs(2).alias("cols"), pairs(3).alias("all_pairs"),
        m_log_m(0).alias("l_cells"), m_log_m(1).alias("l_rows"), m_log_m(2).alias("l_cols"),
        F.max(F.when(F.col("level") == 3, m)).alias("size"),
    )
    size = F.col("size")
    entropy = lambda c: F.log(size) - F.col(c) / size
    expected = F.col("rows") * F.col("cols") / F.col("all_pairs")
    ceiling = (F.col("rows") + F.col("cols")) / 2
    perfect = (F.col("cells") == F.col("rows")) & (F.col("cells") == F.col("cols"))
    h_y, h_p, h_yp = entropy("l_rows"), entropy("l_cols"), entropy("l_cells")
    mutual = F.greatest(h_y + h_p - h_yp, F.lit(0.0))
    mean_h = (h_y + h_p) / 2
    return sums.select(
        *by,
        F.when(perfect, F.lit(1.0)).otherwise((F.col("cells") - expected) / (ceiling - expected)).alias("ari"),
        F.when(mean_h <= 1e-15, F.lit(1.0)).otherwise(mutual / mean_h).alias("nmi"),
    )


def threshold_grid(n: int = 50) -> list[float]:
    """Evenly spaced thresholds on [0.35, 0.65]."""
    return [float(t) for t in np.linspace(0.35, 0.65, n)]


def threshold_scores(
    df: DataFrame, y: str, probs: Column, metric: str = "balanced_accuracy", n_thresholds: int = 50,
    by: list[str] | None = None,
) -> DataFrame:
    """Score of every threshold on the grid.

    A row's prediction depends on its winning class and on how many thresholds its top
    probability reaches. Rows are counted by those two first; only the counts, at most a few
    hundred rows, are then spread over the grid.
    """
    if metric not in METRICS:
        raise ValueError(f"no metric named {metric!r}; there are f1_macro and balanced_accuracy")
    by = by or []
    grid = threshold_grid(n_thresholds)
    steps = F.array(*[F.lit(t) for t in grid])
    best = df.select(*by, F.col(y).alias("y"), V.top_class_suburban_first(probs).alias("top"),
                     F.array_max(probs).alias("best"))
    reached = reduce(lambda a, b: a + b, [(F.col("best") >= t).cast("int") for t in grid])
    counts = best.groupBy(*by, "y", "top", reached.alias("reached")).agg(F.count("*").alias("n"))
    spread = counts.select("*", F.posexplode(steps).alias("step", "threshold"))
    pred = F.when(F.col("reached") > F.col("step"), F.col("top")).otherwise(F.lit(V.SUBURBAN))
    keys = [*by, "threshold"]
    table = spread.withColumn("p", pred).groupBy(*keys, "y", "p").agg(F.sum("n").alias("n"))
    scores = overall(per_label(table, keys), keys)
    return scores.select(*keys, F.col("macro_f1" if metric == "f1_macro" else metric).alias("score"))


def best_threshold(scores: DataFrame, by: list[str] | None = None, digits: int = 12) -> DataFrame:
    """Highest score; among equals the smallest threshold."""
    order = Window.partitionBy(*(by or [])).orderBy(F.round("score", digits).desc(), "threshold")
    return scores.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
