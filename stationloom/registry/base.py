"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stationloom import schema as S
from stationloom.fixtures import with_blocks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle where SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def case_map(expr: str, pairs: dict[str, str]) -> str:
    """SQL form of a constant lookup."""
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


REGION_SQL = case_map("trim(split_part(timezone, '/', 1))", S.TIMEZONE_REGIONS)

GATE_HERE = ["mean_stable_nightlights_5km_year2013", "mean_population_density_5km_year2015"]
NUMERIC_HERE = ["altitude", S.SRTM_90M, S.ROAD, GATE_HERE[1], GATE_HERE[0]]
CODED_HERE = ["climatic_zone_year2016", S.LANDCOVER]


def _code(c: str) -> str:
    return f"CAST(split_part({c}, ' ', 1) AS DOUBLE)"


def _clean(c: str, expr: str | None = None) -> str:
    codes = "-999, -9999" + (", 9999" if c == "altitude" else "")
    return f"CASE WHEN {expr or c} IN ({codes}) THEN NULL ELSE {expr or c} END AS {c}"


# The cleaning steps as CTEs over ``stations_raw``.
CLEANING = {
    "first_rows": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY row_id) AS place FROM stations_raw) q
WHERE place = 1""",
    "decoded": f"""
SELECT row_id, lat, lon, area_code, {REGION_SQL} AS timezone, type_of_area,
  {", ".join(_clean(c) for c in NUMERIC_HERE)},
  {_clean("climatic_zone_year2016", _code("climatic_zone_year2016"))},
  {_clean(S.LANDCOVER, f"floor({_code(S.LANDCOVER)} / 10) * 10")}
FROM first_rows""",
    "gated": f"SELECT * FROM decoded WHERE {GATE_HERE[0]} IS NOT NULL AND {GATE_HERE[1]} IS NOT NULL",
    "structural": f"""
SELECT * REPLACE (coalesce(altitude, {S.SRTM_90M}) AS altitude,
                  coalesce({S.SRTM_90M}, altitude) AS {S.SRTM_90M}) FROM gated""",
    "cleaned": f"""
SELECT * REPLACE (coalesce(CAST(timezone AS VARCHAR), 'nan') AS timezone,
  coalesce(CAST(climatic_zone_year2016 AS VARCHAR), 'nan') AS climatic_zone_year2016,
  coalesce(CAST({S.LANDCOVER} AS VARCHAR), 'nan') AS {S.LANDCOVER})
FROM structural WHERE {S.ROAD} >= 0""",
}


def over_clean(body: str, *names: str, upto: str = "cleaned", **extra: str) -> str:
    """``body`` with the fixture blocks and the cleaning steps up to ``upto`` in front."""
    steps = {}
    for k, v in CLEANING.items():
        steps[k] = v
        if k == upto:
            break
    return with_blocks(body, *names, **steps, **extra)
