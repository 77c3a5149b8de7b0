"""Row-level operators: selection, filters, joins, deduplication and set operations."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions import cleaning as C
from stationloom.session import checkpointed, written

log = logging.getLogger(__name__)


def with_row_id(df: DataFrame) -> DataFrame:
    """The frame with a ``row_id`` that follows input order, kept when already there.

    A new id depends on how the scan is split, so it only serves within one plan.
    """
    if S.ROW_ID in df.columns:
        return df
    return df.withColumn(S.ROW_ID, F.monotonically_increasing_id())


def with_stable_row_id(df: DataFrame) -> DataFrame:
    """The frame with a ``row_id`` that several jobs and both sides of a join agree on.

    New ids are written to the shared folder together with the rows. Tables that carry a
    ``row_id`` from ingest are used as they are.
    """
    return df if S.ROW_ID in df.columns else checkpointed(with_row_id(df))


# -- rows marked instead of dropped ---------------------------------------------------

#: Whether a row is kept so far, and its identifiers and target as they came.
MARK, GIVEN = "__kept", "__given"


def marked(df: DataFrame) -> DataFrame:
    """The frame with all rows marked as kept; what drops rows of other frames unmarks them in this one."""
    given = F.struct(S.ROW_ID, *S.present(df, [*S.ID_COLUMNS, S.TARGET]))
    return df.withColumns({GIVEN: given, MARK: F.lit(True)})


def keep(df: DataFrame, passes: Column) -> DataFrame:
    """Rows that pass; in a marked frame all rows, with those unmarked that don't."""
    if MARK not in df.columns:
        return df.where(passes)
    return df.withColumn(MARK, F.col(MARK) & F.coalesce(passes, F.lit(False)))


def kept(df: DataFrame) -> DataFrame:
    """The rows of a marked frame that are kept; any other frame as it is."""
    return df.where(F.col(MARK)) if MARK in df.columns else df


def handed_back(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row id, identifiers and target of a marked frame as they came, ``columns``, and ``survived``."""
    return df.select(f"{GIVEN}.*", *columns, F.col(MARK).alias("survived"))


# -- projections and filters ----------------------------------------------------------


def keep_columns(df: DataFrame, names: list[str] | None) -> DataFrame:
    """Named columns in the order given; unknown names are ignored, ``None`` keeps all."""
    return df if names is None else df.select(*S.present(df, names))


def drop_sentinels(df: DataFrame) -> DataFrame:
    """Missing-value codes to null in every numeric column but the keys; 9999 only in altitude."""
    numeric = set(S.numeric_columns(df)) - {S.ROW_ID, *S.KEYS}
    return df.select(*[C.without_sentinels(c) if c in numeric else F.col(c) for c in df.columns])


def gate_missing(df: DataFrame, gate: list[str] = S.GATE, mode: str = "any") -> DataFrame:
    """Drop rows whose gate columns are all (mode ``all``) or in part (otherwise) null."""
    passes = gate_condition(df, gate, mode)
    return df if passes is None else keep(df, passes)


def gate_condition(df: DataFrame, gate: list[str] = S.GATE, mode: str = "any") -> Column | None:
    """Condition a row must meet to pass the gate; ``None`` when no gate column exists."""
    names = S.present(df, gate)
    if not names:
        log.warning("no gate column present, missing-data gate skipped")
        return None
    filled = [F.col(c).isNotNull() for c in names]
    return reduce(lambda a, b: a | b if mode == "all" else a & b, filled)


def cross_fill_altitude(df: DataFrame) -> DataFrame:
    """Altitude and the 90 m topography fill each other's gaps."""
    if len(S.present(df, ["altitude", S.SRTM_90M])) < 2:
        return df
    return df.withColumns({
        "altitude": F.coalesce("altitude", S.SRTM_90M),
        S.SRTM_90M: F.coalesce(S.SRTM_90M, "altitude"),
    })


def road_in_range(df: DataFrame) -> DataFrame:
    """Rows with a known, non-negative distance to the next major road."""
    return keep(df, F.col(S.ROAD) >= 0) if S.ROAD in df.columns else df


def categories_to_text(df: DataFrame) -> DataFrame:
    """Categorical columns as text, missing spelled ``nan``."""
    cats = set(S.present(df, S.CATEGORICAL))
    return df.select(*[C.as_category(F.col(c)).alias(c) if c in cats else F.col(c) for c in df.columns])


def split_labelled(df: DataFrame, target: str = S.TARGET) -> tuple[DataFrame, DataFrame]:
    """Labelled and unlabelled rows."""
    known = C.is_labelled(target)
    return df.where(known), df.where(~known)


def identifiers(df: DataFrame) -> DataFrame:
    """Row id, identifier columns and the target where present."""
    return df.select(S.ROW_ID, *S.present(df, [*S.ID_COLUMNS, S.TARGET]))


def align_features(df: DataFrame, features: list[str], carry: list[str] | None = None) -> DataFrame:
    """Exactly the listed features, absent ones as 0, plus the columns to carry along."""
    kept = S.present(df, carry or [])
    return df.select(*kept, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])


def predictors(df: DataFrame, excluded: list[str]) -> DataFrame:
    """All columns but the excluded ones."""
    return df.drop(*excluded)


def map_clusters(df: DataFrame, labels_map: dict | None, cluster: str, out: str) -> DataFrame:
    """Cluster ids turned into labels; the map is required."""
    if labels_map is None:
        raise ValueError("clusters need a map to labels")
    return df.withColumn(out, C.lookup(F.col(cluster), labels_map))


def tagged_points(df: DataFrame, tag: str) -> DataFrame:
    """Coordinates with the name of the set they belong to."""
    return df.select("lat", "lon", F.lit(tag).alias("split"))


# -- joins ----------------------------------------------------------------------------


def join_on_keys(left: DataFrame, right: DataFrame, how: str = "inner", keys: list[str] = S.KEYS) -> DataFrame:
    """Equi-join on coordinates where null keys match each other.

    No broadcast is forced: the optimizer picks it from measured sizes, and adaptive
    execution splits a hot key on the probing side.
    """
    renamed = {k: f"__{k}" for k in keys}
    rest = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]
    other = right.select(*[F.col(k).alias(v) for k, v in renamed.items()], *rest)
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[v]) for k, v in renamed.items()])
    return left.join(other, same, how).drop(*renamed.values())


def join_species(frames: list[DataFrame]) -> DataFrame:
    """Inner join of any number of species tables."""
    return reduce(join_on_keys, frames)


def fill_not_scored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Constant message where a row has no prediction."""
    return df.withColumns({c: F.when(F.col("survived"), F.col(c)).otherwise(F.lit(S.NOT_SCORED)) for c in columns})


# -- deduplication --------------------------------------------------------------------


def keep_first(df: DataFrame, keys: list[str] = S.KEYS, order: str = S.ROW_ID) -> DataFrame:
    """First row per key in input order.

    The ``= 1`` filter on ``row_number`` lets Spark cut each map task's output to one row
    per key before the shuffle, so a hot key costs one row per task. A marked frame keeps all
    its rows: those of repeated keys look up the first ``order`` of their key. The repeated keys are
    counted map-side and written first, so Spark knows their size when it plans: it broadcasts
    them and moves no row, or, if they are many, joins by key and splits hot ones.
    """
    if len(S.present(df, keys)) < len(keys):
        return df
    if MARK in df.columns:
        counted = kept(df).groupBy(*keys).agg(F.min(order).alias("__first"), F.count("*").alias("__n"))
        repeated = written(counted.where(F.col("__n") > 1).drop("__n"), "repeated-keys")
        found = join_on_keys(df, repeated, "left", keys)
        return keep(found, F.col("__first").isNull() | (F.col(order) == F.col("__first"))).drop("__first")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")


def duplicate_rows(df: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    """Every row whose key occurs more than once."""
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1)
    return join_on_keys(df, repeated, "left_semi", keys)


def drop_all_duplicates(df: DataFrame, value: str, keys: list[str] = S.KEYS) -> DataFrame:
    """Keys that occur exactly once, with their value; counted map-side, no window."""
    single = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(value).alias(value))
    return single.where(F.col("__n") == 1).drop("__n")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
