"""Learned column transforms: fitting is an aggregate job, applying is a projection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.functions import numeric as N
from stationloom.operators.quantiles import exact_quantiles
from stationloom.operators.summaries import sample_skewness

_TINY = 2.2250738585072014e-308  # smallest normal double
_NEAR = 1e-12  # lambdas this close to a branch point take its limit
_FARTHEST = 200.0  # beyond it a transform is flat in double precision, so the grid stops moving outward


def replaced(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """The frame with some columns replaced in place."""
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


# -- capping --------------------------------------------------------------------------


def iqr_bounds(df: DataFrame, columns: list[str], **options) -> dict[str, tuple[float, float]]:
    """Fences ``q1 - 1.5 iqr`` and ``q3 + 1.5 iqr``; columns without values are left out."""
    found = exact_quantiles(df, {c: F.col(c).cast("double") for c in columns}, [0.25, 0.75], **options)
    return {
        c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in found.items() if q1 is not None
    }


def cap(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip columns to learned bounds."""
    return replaced(df, {c: N.clip(F.col(c), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


# -- encoding -------------------------------------------------------------------------


def sorted_levels(df: DataFrame, columns: list[str], limit: int | None = None) -> dict[str, list[str]]:
    """Distinct values per column, sorted.

    One output column or literal per level follows. With a ``limit``, the exact number is checked before
    any level reaches the driver.
    """
    out: dict[str, list[str]] = {c: [] for c in columns}
    if not columns:
        return out
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    distinct = df.select(F.explode(pairs).alias("s")).select("s.*").where("level IS NOT NULL").distinct()
    if limit is not None:
        distinct = distinct.persist(StorageLevel.MEMORY_AND_DISK)
        for r in distinct.groupBy("column").count().collect():
            if r["count"] > limit:
                distinct.unpersist()
                raise ValueError(f"column {r['column']!r} has {r['count']} levels, more than the {limit} allowed")
    for r in distinct.collect():
        out[r["column"]].append(r["level"])
    if limit is not None:
        distinct.unpersist()
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True) -> DataFrame:
    """Float indicator columns ``<column>_<level>`` behind the other columns."""
    extra = [
        F.when(F.col(c) == level, 1.0).otherwise(0.0).alias(f"{c}_{level}")
        for c, values in levels.items() if c in df.columns
        for level in (values[1:] if drop_first else values)
    ]
    return df.select(*[c for c in df.columns if c not in levels], *extra)


def label_codes(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Alphabetical integer codes; a value not seen when fitting gets the first code."""
    known = {c: values for c, values in levels.items() if c in df.columns and values}
    if not known:
        return df
    outs = [f"__code_{c}" for c in known]
    indexer = StringIndexerModel.from_arrays_of_labels(
        list(known.values()), inputCols=list(known), outputCols=outs, handleInvalid="keep")
    text = replaced(df, {c: F.col(c).cast("string") for c in known})
    coded = indexer.transform(text)
    return coded.select(*[
        F.when(F.col(f"__code_{c}") < len(known[c]), F.col(f"__code_{c}")).otherwise(0).cast("int").alias(c)
        if c in known else F.col(c) for c in df.columns])


# -- skewness -------------------------------------------------------------------------


def skewed_columns(df: DataFrame, columns: list[str], limit: float = 1.0) -> list[str]:
    """Columns whose absolute sample skewness exceeds the limit."""
    skew = sample_skewness(df, columns)
    return [c for c in columns if skew[c] is not None and abs(skew[c]) > limit]


def _yeo_johnson_block(x: np.ndarray, lam: float) -> np.ndarray:
    """Yeo-Johnson of a block of present values."""
    out, up = np.empty_like(x), x >= 0
    out[up] = np.log1p(x[up]) if abs(lam) < _NEAR else np.expm1(lam * np.log1p(x[up])) / lam
    down = 2 - lam
    out[~up] = -np.log1p(-x[~up]) if abs(down) < _NEAR else -np.expm1(down * np.log1p(-x[~up])) / down
    return out


def _moments_on_grid(numbers: DataFrame, grid: np.ndarray) -> dict[tuple[int, int], float]:
    """Population variance of each column's transform at each lambda, in one pass.

    A task keeps count, mean and squared deviations per column and grid point, merged batch by batch; one row
    for each leaves it.
    """
    columns, points = grid.shape

    def run(batches):
        count, mean, spread = np.zeros((columns, points)), np.zeros((columns, points)), np.zeros((columns, points))
        for pdf in batches:
            for j in range(columns):
                x = pdf.iloc[:, j].to_numpy(dtype=float, na_value=np.nan)
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                for i in range(points):
                    with np.errstate(over="ignore", invalid="ignore"):
                        y = _yeo_johnson_block(x, grid[j, i])
                        m = y.mean()
                        n = count[j, i] + len(y)
                        gap = m - mean[j, i]
                        spread[j, i] += ((y - m) ** 2).sum() + gap * gap * count[j, i] * len(y) / n
                        mean[j, i] += gap * len(y) / n
                        count[j, i] = n
        j, i = np.nonzero(count)
        yield pd.DataFrame({"j": j, "i": i, "n": count[j, i], "m": mean[j, i], "s": spread[j, i]})

    parts = numbers.mapInPandas(run, "j int, i int, n double, m double, s double")
    whole = parts.groupBy("j", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum("s").alias("s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    return {(r["j"], r["i"]): (r["s"] + max(0.0, r["q"] - r["t"] * r["t"] / r["n"])) / r["n"] for r in whole.collect()}


def yeo_johnson_lambdas(
    df: DataFrame, columns: list[str], lo: float = -5.0, hi: float = 5.0, points: int = 41, tolerance: float = 1e-6
) -> dict[str, float]:
    """Maximum-likelihood lambda per column.

    Each pass scores a grid of lambdas for all columns at once. Then a column's grid closes in around the best
    lambda, or moves outward when the best lies on its edge, until its step is below ``tolerance``.
    """
    if not columns:
        return {}
    numbers = df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
    x = [F.col(f"x{j}") for j in range(len(columns))]
    sums = numbers.agg(
        *[F.count(c).alias(f"n{j}") for j, c in enumerate(x)],
        *[F.sum(F.signum(c) * F.log1p(F.abs(c))).alias(f"l{j}") for j, c in enumerate(x)],
    ).first()
    best = dict.fromkeys(columns, 1.0)
    spans = {j: (lo, hi) for j in range(len(columns)) if sums[f"n{j}"]}
    while spans:
        order = list(spans)
        grid = np.array([np.linspace(*spans[j], points) for j in order])
        variance = _moments_on_grid(numbers.select(*[f"x{j}" for j in order]), grid)
        for k, j in enumerate(order):
            n, logs = sums[f"n{j}"], sums[f"l{j}"]
            scores = []
            for i, at in enumerate(grid[k]):
                var = variance.get((k, i))
                usable = var is not None and math.isfinite(var) and var > _TINY
                scores.append(-n / 2 * math.log(var) + (at - 1) * logs if usable else -math.inf)
            i = max(range(points), key=scores.__getitem__)
            a, b = spans[j]
            step = (b - a) / (points - 1)
            if scores[i] == -math.inf or step < tolerance:
                best[columns[j]] = 1.0 if scores[i] == -math.inf else float(grid[k, i])
                del spans[j]
                continue
            best[columns[j]] = float(grid[k, i])
            reach = (b - a) / 2 if i in (0, points - 1) and abs(grid[k, i]) < _FARTHEST else step
            spans[j] = (best[columns[j]] - reach, best[columns[j]] + reach)
    return best


def power_state(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """Lambda, mean and scale of each column's Yeo-Johnson transform."""
    lambdas = yeo_johnson_lambdas(df, columns)
    shaped = df.select(*[N.yeo_johnson(F.col(c).cast("double"), lam).alias(c) for c, lam in lambdas.items()])
    scales = standard_state(shaped, columns)
    return {c: (lambdas[c], *scales[c]) for c in columns}


def apply_power(df: DataFrame, state: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Yeo-Johnson with learned lambdas, then zero mean and unit variance."""
    return replaced(df, {
        c: N.shift_scale(N.yeo_johnson(F.col(c).cast("double"), lam), mean, scale)
        for c, (lam, mean, scale) in state.items() if c in df.columns
    })


# -- scaling --------------------------------------------------------------------------


def _unit(scale: float | None) -> float:
    return float(scale) if scale else 1.0


def standard_state(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation; a constant column gets divisor 1."""
    if not columns:
        return {}
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns)
                   for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, _unit(row[f"s{i}"])) for i, c in enumerate(columns)}


def minmax_state(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Minimum and range; a constant column gets divisor 1 and so maps to 0."""
    if not columns:
        return {}
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns)
                   for n, f in (("a", F.min), ("b", F.max))]).first()
    return {
        c: (float(row[f"a{i}"] or 0.0), _unit((row[f"b{i}"] or 0.0) - (row[f"a{i}"] or 0.0)))
        for i, c in enumerate(columns)
    }


def robust_state(df: DataFrame, columns: list[str], **options) -> dict[str, tuple[float, float]]:
    """Median and interquartile range."""
    found = exact_quantiles(df, {c: F.col(c).cast("double") for c in columns}, [0.25, 0.5, 0.75], **options)
    return {c: (0.0, 1.0) if m is None else (m, _unit(q3 - q1)) for c, (q1, m, q3) in found.items()}


SCALERS = {"standard": standard_state, "minmax": minmax_state, "robust": robust_state}


def scale_state(df: DataFrame, kind: str, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Shift and divisor per column for the named scaler."""
    if kind not in SCALERS:
        raise ValueError(f"no scaler named {kind!r}; there are {', '.join(SCALERS)}")
    return SCALERS[kind](df, columns)


def apply_scale(df: DataFrame, state: dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - shift) / divisor`` with learned constants."""
    return replaced(df, {c: N.shift_scale(F.col(c), a, b) for c, (a, b) in state.items() if c in df.columns})
