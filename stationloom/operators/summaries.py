"""Aggregates for exploration: counts, distributions, box statistics, correlation."""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions import cleaning as C
from stationloom.operators.quantiles import exact_quantiles

log = logging.getLogger(__name__)

DISTRIBUTION_ORDER = ["unknown", "urban", "suburban", "rural"]


def size_report(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Rows in total, labelled and unlabelled, in one pass."""
    known = C.is_labelled(target)
    return df.agg(
        F.count("*").alias("total"), F.count_if(known).alias("labelled"), F.count_if(~known).alias("unlabelled"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def target_counts(df: DataFrame, target: str = S.TARGET) -> DataFrame | None:
    """Rows per label; warns and gives nothing when the target is missing."""
    if target not in df.columns:
        log.warning("%r not in the columns", target)
        return None
    return value_counts(df, target)


def category_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per column and value for all categorical columns in one job."""
    columns = columns or S.string_columns(df, without=("area_code",))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("s")).select("s.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def split_distribution(
    full: DataFrame, train: DataFrame, test: DataFrame, target: str = S.TARGET,
    categories: list[str] | None = None,
) -> DataFrame:
    """Class counts of the full, train and test data in a fixed category order; absent is null."""
    categories = categories or DISTRIBUTION_ORDER
    parts = {"full": full, "train": train, "test": test}
    tagged = None
    for name, df in parts.items():
        part = df.groupBy(F.col(target).alias("category")).agg(F.count("*").alias("n")).withColumn("split", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    wide = tagged.groupBy("category").pivot("split", list(parts)).agg(F.sum("n"))
    order = F.array(*[F.lit(c) for c in categories])
    spine = df.sparkSession.range(1).select(F.posexplode(order).alias("pos", "category"))
    return spine.join(wide, "category", "left").select("pos", "category", *parts).orderBy("pos")


def sample_skewness(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Bias-corrected skewness per column; null below three values, 0 for a constant."""
    row = df.agg(*[
        f(c).alias(f"{name}_{i}")
        for i, c in enumerate(columns)
        for name, f in (("n", F.count), ("g", F.skewness), ("v", F.var_pop))
    ]).first()
    out = {}
    for i, c in enumerate(columns):
        n, g, v = row[f"n_{i}"], row[f"g_{i}"], row[f"v_{i}"]
        if n < 3:
            out[c] = None
        else:
            out[c] = 0.0 if not v or g is None or math.isnan(g) else g * math.sqrt(n * (n - 1)) / (n - 2)
    return out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair below the diagonal, pairwise complete.

    Each task multiplies its Arrow batches into one matrix of centred moments, and the
    matrices are summed cell by cell. That is one pass for any number of pairs, where an
    aggregate per pair grows with their square.
    """
    d = len(columns)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    centre = np.array([v or 0.0 for v in numbers.agg(*[F.avg(c).alias(c) for c in columns]).first()])

    def moments(batches):
        total = np.zeros((3 * d, 3 * d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float, na_value=np.nan) - centre
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            z = np.hstack([x, x * x, there])
            total += z.T @ z
        i, j = np.nonzero(np.kron([[1, 0, 1], [0, 0, 1], [0, 0, 1]], np.ones((d, d))))
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = numbers.mapInPandas(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    m = np.zeros((3 * d, 3 * d))
    for r in cells.collect():
        m[r["i"], r["j"]] = r["v"]
    n, sums = m[2 * d:, 2 * d:], m[:d, 2 * d:]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = m[:d, :d] - sums * sums.T / n
        var = m[d:2 * d, 2 * d:] - sums * sums / n
        r = cov / np.sqrt(var * var.T)
    rows = [
        (columns[j], columns[i], float(r[j, i]) if np.isfinite(r[j, i]) else None) for j in range(d) for i in range(j)
    ]
    return df.sparkSession.createDataFrame(rows, "row string, column string, r double")


def value_range(df: DataFrame, column: str) -> tuple[float, float, int]:
    """Minimum, maximum and count of a column."""
    return tuple(df.agg(F.min(column), F.max(column), F.count(column)).first())


def bin_index(col: Column, lo: float, hi: float, bins: int) -> Column:
    """Zero-based equal-width bin, the last one closed on the right."""
    if hi == lo:
        return F.lit(bins // 2)
    place = F.floor((col - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo))
    return F.least(place, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts of equal-width bins over the range of the column, empty bins as 0.

    A constant column gets the unit-wide range centred on its value.
    """
    lo, hi, n = value_range(df, column)
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if not n:
        empty = F.lit(None).cast("double")
        return spine.select("bin", empty.alias("left"), empty.alias("right"), F.lit(0).cast("bigint").alias("n"))
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(bin_index(F.col(column), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"))
    )
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    edge = lambda k: F.lit(lo) + k * F.lit(width)
    return spine.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"))


def kde_curve(df: DataFrame, column: str, bins: int = 10, points: int = 200) -> DataFrame:
    """Gaussian density on a grid over the data range, scaled to the histogram's counts.

    Scott's bandwidth. See ``kde_curves``.
    """
    return kde_curves(df, [column], bins, points).drop("column")


def kde_curves(df: DataFrame, columns: list[str], bins: int = 10, points: int = 200) -> DataFrame:
    """``kde_curve`` of many columns: one aggregate for their ranges, and one pass in which a task adds up
    each column's kernels on its grid, batch by batch. One row per grid point leaves a task."""
    spark, schema = df.sparkSession, "column string, point int, x double, density double"
    numbers = df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
    row = numbers.agg(*[f(f"x{j}").alias(f"{n}{j}") for j in range(len(columns))
                        for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count), ("sd", F.stddev_samp))]).first()
    usable = [j for j in range(len(columns)) if row[f"n{j}"] and row[f"sd{j}"]]
    if not usable:
        return spark.createDataFrame([], schema)
    low, high = (np.array([row[f"{k}{j}"] for j in usable]) for k in ("lo", "hi"))
    width = np.array([row[f"sd{j}"] * row[f"n{j}"] ** -0.2 for j in usable])
    grid = low[:, None] + np.arange(points) * ((high - low) / (points - 1))[:, None]
    scale = (high - low) / bins / (width * math.sqrt(2 * math.pi))

    def run(batches):
        total = np.zeros_like(grid)
        for pdf in batches:
            for k in range(len(usable)):
                x = pdf.iloc[:, k].to_numpy(dtype=float, na_value=np.nan)
                x = x[~np.isnan(x)]
                for a in range(0, len(x), 4096):
                    gap = (x[a:a + 4096, None] - grid[k]) / width[k]
                    total[k] += np.exp(-0.5 * gap * gap).sum(axis=0)
        k, point = np.indices(total.shape).reshape(2, -1)
        yield pd.DataFrame({"k": k, "point": point, "s": total.ravel()})

    sums = numbers.select(*[f"x{j}" for j in usable]).mapInPandas(run, "k int, point int, s double")
    sums = sums.groupBy("k", "point").agg(F.sum("s").alias("s"))
    facts = spark.createDataFrame(
        [(k, columns[j], float(low[k]), float((high[k] - low[k]) / (points - 1)), float(scale[k])) for k, j in enumerate(usable)],
        "k int, column string, low double, step double, scale double")
    return sums.join(facts, "k").select(
        "column", "point", (F.col("low") + F.col("point") * F.col("step")).alias("x"), (F.col("s") * F.col("scale")).alias("density"))


def histograms(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """``histogram`` of many columns: one aggregate for all ranges, one grouped count for all bins."""
    spark = df.sparkSession
    numbers = df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
    row = numbers.agg(*[f(f"x{j}").alias(f"{n}{j}") for j in range(len(columns))
                        for n, f in (("lo", F.min), ("hi", F.max))]).first()
    places, edges = [], []
    for j, c in enumerate(columns):
        lo, hi = row[f"lo{j}"], row[f"hi{j}"]
        if lo is None:
            edges += [(c, k, None, None) for k in range(bins)]
            continue
        x = F.col(f"x{j}")
        place = F.when(x.isNotNull(), bin_index(x, lo, hi, bins))
        places.append(F.struct(F.lit(c).alias("column"), place.alias("bin")))
        if hi == lo:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        edges += [(c, k, lo + k * width, lo + (k + 1) * width) for k in range(bins)]
    spine = spark.createDataFrame(edges, "column string, bin int, left double, right double")
    if not places:
        return spine.withColumn("n", F.lit(0).cast("bigint"))
    counts = numbers.select(F.inline(F.array(*places))).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count("*").alias("n"))
    return spine.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "left", "right", F.coalesce("n", F.lit(0)).alias("n"))


def box_table(df: DataFrame, columns: dict[str, Column], label: str = "column", **options) -> DataFrame:
    """Box statistics per named expression; whiskers are the extreme points inside 1.5 IQR.

    Only the named values are kept for the passes over them.
    """
    names = {name: f"c{i}" for i, name in enumerate(columns)}
    kept = df.select(*[columns[n].cast("double").alias(c) for n, c in names.items()]).persist(StorageLevel.MEMORY_AND_DISK)
    quartiles = exact_quantiles(kept, {n: F.col(c) for n, c in names.items()}, [0.25, 0.5, 0.75], **options)
    aggs = []
    for name, c in names.items():
        q1, _, q3 = quartiles[name]
        lo, hi = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        inside = (F.col(c) >= F.lit(lo).cast("double")) & (F.col(c) <= F.lit(hi).cast("double"))
        aggs += [F.min(F.when(inside, F.col(c))).alias(f"{c}_lo"), F.max(F.when(inside, F.col(c))).alias(f"{c}_hi"),
                 F.count_if(~inside).alias(f"{c}_out"), F.count(c).alias(f"{c}_n")]
    found = kept.agg(*aggs).first()
    kept.unpersist()
    rows = [(name, *quartiles[name], *[found[f"{c}_{part}"] for part in ("lo", "hi", "out", "n")])
            for name, c in names.items()]
    return df.sparkSession.createDataFrame(
        rows, f"`{label}` string, q1 double, median double, q3 double, whisker_lo double, whisker_hi double, "
              "outliers bigint, n bigint")


def box_by_class(
    df: DataFrame, value: str, pred: str, classes: list[str] | None = None, **options
) -> DataFrame:
    """Box statistics of a value per predicted class."""
    classes = classes or list(reversed(S.CLASSES))
    parts = {c: F.when(F.col(pred).eqNullSafe(F.lit(c)), F.col(value)) for c in classes}
    return box_table(df, parts, label=pred, **options)


def axis_extent(df: DataFrame, x: str, y: str, pad: float = 0.1) -> DataFrame:
    """Range of two coordinates widened by a share of its length."""
    r = df.agg(*[f(c).alias(f"{c}_{n}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))])
    out = []
    for c in (x, y):
        lo, hi = F.col(f"{c}_min"), F.col(f"{c}_max")
        out += [(lo - (hi - lo) * pad).alias(f"{c}_lo"), (hi + (hi - lo) * pad).alias(f"{c}_hi")]
    return r.select(*out)


def cleaning_audit(raw: DataFrame, first: DataFrame, gate: Column | None, road: Column | None) -> DataFrame:
    """Rows in and out of each cleaning step that drops rows."""
    gate = F.lit(True) if gate is None else gate
    road = F.lit(True) if road is None else F.coalesce(road, F.lit(False))
    names = ["total", "unique", "gated", "kept"]
    none = F.lit(None).cast("bigint")
    stages = first.agg(
        F.count("*").alias("unique"), F.count_if(gate).alias("gated"), F.count_if(gate & road).alias("kept"))
    counts = raw.agg(F.count("*").alias("total")).withColumns({c: none for c in names[1:]})
    both = counts.unionByName(stages.withColumn("total", none)).agg(*[F.max(c).alias(c) for c in names])
    step = lambda name, a, b: F.struct(
        F.lit(name).alias("step"), F.col(a).alias("rows_in"), F.col(b).alias("rows_out"))
    steps = F.array(
        step("duplicates", "total", "unique"), step("missing_gate", "unique", "gated"),
        step("road_distance", "gated", "kept"))
    return both.select(F.explode(steps).alias("s")).select("s.*")
