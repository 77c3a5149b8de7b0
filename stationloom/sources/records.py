"""Nested station records in JSON: flattening, rejects and lookups by code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions.cleaning import is_labelled
from stationloom.operators import rows as R

# Paths of the record format.
REQUIRED_PATHS = {
    "lat": "$.coordinates.lat",
    "lon": "$.coordinates.lng",
    "area_code": "$.codes[0]",
    "timezone": "$.timezone",
    "type_of_area": "$.type_of_area",
    "altitude": "$.coordinates.alt",
}
METADATA_PATH = "$.globalmeta"
# End of fixed values.


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("v", path, kind)


def _kind(name: str) -> str:
    return "string" if name in S.CATEGORICAL else "double"


def _documents(df: DataFrame, body: str) -> DataFrame:
    return R.with_row_id(df).withColumn("v", F.try_parse_json(F.col(body)))


def _emit(df: DataFrame, when: Column, columns: list[Column]) -> DataFrame:
    """The columns for rows that meet a condition.

    A filter on parsed fields would be pushed below the parsing and repeat it for every field
    it looks at. A generator keeps each document parsed once.
    """
    return df.select(F.inline(F.when(when, F.array(F.struct(*columns)))))


def _has(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [_get(REQUIRED_PATHS[c], "variant").isNotNull() for c in names])


def _whole() -> Column:
    """Whether a record has every required key.

    A key that is absent makes a record malformed, and so does missing or null metadata; a
    JSON null in a required field does not.
    """
    meta = _get(METADATA_PATH, "variant")
    return F.coalesce(_has(list(REQUIRED_PATHS)) & meta.isNotNull() & ~F.is_variant_null(meta), F.lit(False))


def flat_columns() -> list[Column]:
    """The 30 columns of the station table, read out of the variant."""
    base = [_get(p, _kind(c)).alias(c) for c, p in REQUIRED_PATHS.items()]
    return base + [_get(f"{METADATA_PATH}.{c}", _kind(c)).alias(c) for c in S.METADATA_FIELDS]


def _codes() -> Column:
    return F.array_distinct(_get("$.codes", "array<string>"))


def flatten(df: DataFrame, body: str = "body") -> DataFrame:
    """Well-formed records as station rows."""
    carried = [F.col(c) for c in S.present(df, [S.ROW_ID])]
    return _emit(_documents(df, body), _whole(), [*carried, *flat_columns()])


def rejects(df: DataFrame, body: str = "body") -> DataFrame:
    """Malformed records."""
    return _emit(_documents(df, body), ~_whole(), [F.col(c) for c in [*S.present(df, [S.ROW_ID]), body]])


def code_table(spark: SparkSession, codes: str | list[str]) -> DataFrame:
    """Requested codes with their position in the request."""
    listed = [codes] if isinstance(codes, str) else list(codes)
    return spark.createDataFrame(list(enumerate(listed)), "pos bigint, area_code string")


def lookup_codes(df: DataFrame, codes: DataFrame, body: str = "body") -> DataFrame:
    """One station row per requested code that exists, in request order.

    A record answers to each of its codes; its first one is reported as ``area_code``.
    """
    found = _emit(_documents(df, body), _whole(), [F.col(S.ROW_ID), *flat_columns(), _codes().alias("codes")])
    wanted = codes.select("pos", F.col("area_code").alias("requested_code"))
    hits = found.withColumn("requested_code", F.explode("codes")).drop("codes").join(wanted, "requested_code")
    return R.keep_first(hits, keys=["pos"]).orderBy("pos")


def missing_codes(codes: DataFrame, found: DataFrame) -> DataFrame:
    """Requested codes that no record answered to."""
    return codes.join(found.select("pos"), "pos", "left_anti")


def station_coord(df: DataFrame, code: str, body: str = "body") -> DataFrame:
    """Coordinates, altitude and label of one station; a required field that is absent raises."""
    own = _emit(_documents(df, body), F.array_contains(_get("$.codes", "array<string>"), code), [F.col("v")])

    def need(name: str) -> Column:
        path = REQUIRED_PATHS[name]
        absent = F.raise_error(F.lit(f"station {code}: {path} is missing"))
        return F.when(_get(path, "variant").isNull(), absent.cast(_kind(name))).otherwise(_get(path, _kind(name)))

    return own.select(
        need("lat").alias("lat"), need("lon").alias("lon"), need("altitude").alias("alt"),
        need(S.TARGET).alias(S.TARGET))


def label_pairs(spark: SparkSession, station_codes: dict[str, list[str]]) -> DataFrame:
    """Long form of a map from area type to codes."""
    one = spark.createDataFrame([(station_codes,)], "m map<string, array<string>>")
    by_type = one.select(F.explode("m").alias("area_type", "codes"))
    return by_type.select("area_type", F.explode("codes").alias("requested_code"))


def hand_label_set(
    df: DataFrame, pairs: DataFrame, body: str = "body", source_label: str = "type_of_area_source"
) -> DataFrame:
    """One row per (area type, code) whose station exists and is labelled by the source.

    ``source_label`` names the column with the source's own label.
    """
    needed = ["lat", "lon", "altitude", S.TARGET]
    fields = [_get(REQUIRED_PATHS[c], _kind(c)).alias(c) for c in needed]
    found = _emit(_documents(df, body), _has(needed), [F.col(S.ROW_ID), *fields, _codes().alias("codes")])
    found = found.withColumn("requested_code", F.explode("codes")).drop("codes")
    hits = R.keep_first(found.join(pairs, "requested_code"), keys=["area_type", "requested_code"])
    return hits.where(is_labelled()).select(
        "lat", "lon", F.col("requested_code").alias("area_code"), "altitude",
        F.col(S.TARGET).alias(source_label), F.col("area_type").alias("type_of_area_gmap"))
