"""Silhouette of a clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and distances that a task holds at once.
BLOCK_ROWS, PAIRS = 20_000, 2_000_000


def squared_silhouette(df: DataFrame, vector: str = "x", cluster: str = "cluster") -> float:
    """Mean silhouette on squared distances: linear cost, for any table size."""
    labelled = df.select(F.col(vector).alias("x"), F.col(cluster).cast("double").alias("c"))
    return ClusteringEvaluator(featuresCol="x", predictionCol="c").evaluate(labelled)


def _block_sums(_key, points: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Distance sums from each point of one block to each cluster of another."""
    parts = []
    if len(points) and len(others):
        b = np.stack(others["other_v"].to_numpy()).astype(float)
        clusters, code = np.unique(others["other_c"].to_numpy(), return_inverse=True)
        member = np.eye(len(clusters))[code]
        a = np.stack(points["v"].to_numpy()).astype(float)
        centre = b.mean(axis=0)
        a, b = a - centre, b - centre
        of_a, of_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
        step = max(1, PAIRS // len(b))
        for at in range(0, len(a), step):
            own = a[at:at + step]
            size = of_a[at:at + step, None] + of_b[None, :]
            square = size - 2.0 * (own @ b.T)
            # the product loses what is much closer than the points are far out; there differences decide
            row, col = np.nonzero(square <= 1e-6 * size)
            for k in range(0, len(row), PAIRS // 16):
                r, c = row[k:k + PAIRS // 16], col[k:k + PAIRS // 16]
                square[r, c] = ((own[r] - b[c]) ** 2).sum(axis=1)
            sums = np.sqrt(square) @ member
            parts += [
                pd.DataFrame({"id": points["id"].to_numpy()[at:at + step], "own": points["c"].to_numpy()[at:at + step],
                              "c": c, "s": sums[:, i]})
                for i, c in enumerate(clusters)
            ]
    return pd.concat(parts) if parts else pd.DataFrame({"id": [], "own": [], "c": [], "s": []})


def exact_silhouette(
    df: DataFrame, point_id: str, values: str, cluster: str = "cluster", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Silhouette per point on Euclidean distances.

    The measure compares every point with every other, so its cost is quadratic. Points are
    dealt into blocks of bounded size and each task handles one pair of blocks; only sums
    per point and cluster leave a task. Use ``squared_silhouette`` on large tables.
    """
    base = df.select(
        F.col(point_id).alias("id"), F.col(cluster).cast("int").alias("c"), F.col(values).cast("array<double>").alias("v"))
    sizes = {r["c"]: r["count"] for r in base.groupBy("c").count().collect()}
    blocks = max(1, math.ceil(sum(sizes.values()) / block_rows))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select("id", "c", "v", F.col("block").alias("i"), every.alias("j"))
    right = dealt.select(
        F.col("c").alias("other_c"), F.col("v").alias("other_v"), F.col("block").alias("other_j"), every.alias("other_i"))
    sums = left.groupBy("i", "j").cogroup(right.groupBy("other_i", "other_j")).applyInPandas(
        _block_sums, "id bigint, own int, c int, s double")
    per_cluster = sums.groupBy("id", "own", "c").agg(F.sum("s").alias("s"))
    size_of = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])
    own = F.col("own") == F.col("c")
    scored = per_cluster.groupBy("id", "own").agg(
        F.max(F.when(own, F.col("s"))).alias("inside"),
        F.min(F.when(~own, F.col("s") / size_of[F.col("c")])).alias("b"),
    ).withColumn("n", size_of[F.col("own")]).withColumn("a", F.col("inside") / F.greatest(F.col("n") - 1, F.lit(1)))
    top = F.greatest("a", "b")
    value = F.when((F.col("n") == 1) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return scored.select(F.col("id").alias(point_id), F.col("own").alias(cluster), value.alias("silhouette"))
