"""Column groups and record types of the station table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names, label values and the time-zone prefixes are the data contract.

ID_COLUMNS = ["lat", "lon", "area_code"]
TARGET = "type_of_area"
UNLABELLED = "unknown"
CLASSES = ["rural", "suburban", "urban"]

CODED_CATEGORIES = [
    "climatic_zone_year2016",
    "htap_region_tier1_year2010",
    "dominant_landcover_year2012",
    "landcover_description_25km_year2012",
    "dominant_ecoregion_year2017",
    "ecoregion_description_25km_year2017",
]
CATEGORICAL = ["area_code", "timezone", TARGET, *CODED_CATEGORIES]

NUMERIC = [
    "altitude",
    "mean_topography_srtm_alt_90m_year1994",
    "mean_topography_srtm_alt_1km_year1994",
    "max_topography_srtm_relative_alt_5km_year1994",
    "min_topography_srtm_relative_alt_5km_year1994",
    "stddev_topography_srtm_relative_alt_5km_year1994",
    "distance_to_major_road_year2020",
    "mean_stable_nightlights_1km_year2013",
    "mean_stable_nightlights_5km_year2013",
    "max_stable_nightlights_25km_year2013",
    "max_stable_nightlights_25km_year1992",
    "mean_population_density_250m_year2015",
    "mean_population_density_5km_year2015",
    "max_population_density_25km_year2015",
    "mean_population_density_250m_year1990",
    "mean_population_density_5km_year1990",
    "max_population_density_25km_year1990",
    "mean_nox_emissions_10km_year2015",
    "mean_nox_emissions_10km_year2000",
]
GATE = [
    "mean_stable_nightlights_5km_year2013",
    "max_stable_nightlights_25km_year2013",
    "max_stable_nightlights_25km_year1992",
    "mean_population_density_250m_year2015",
    "mean_population_density_5km_year2015",
    "max_population_density_25km_year2015",
    "mean_population_density_250m_year1990",
    "mean_population_density_5km_year1990",
    "max_population_density_25km_year1990",
]
METADATA_FIELDS = [
    "htap_region_tier1_year2010",
    "dominant_landcover_year2012",
    "landcover_description_25km_year2012",
    "dominant_ecoregion_year2017",
    "ecoregion_description_25km_year2017",
    "climatic_zone_year2016",
    "distance_to_major_road_year2020",
    "mean_stable_nightlights_1km_year2013",
    "mean_stable_nightlights_5km_year2013",
    "max_stable_nightlights_25km_year2013",
    "max_stable_nightlights_25km_year1992",
    "mean_population_density_250m_year2015",
    "mean_population_density_5km_year2015",
    "max_population_density_25km_year2015",
    "mean_population_density_250m_year1990",
    "mean_population_density_5km_year1990",
    "max_population_density_25km_year1990",
    "mean_nox_emissions_10km_year2015",
    "mean_nox_emissions_10km_year2000",
    "mean_topography_srtm_alt_90m_year1994",
    "mean_topography_srtm_alt_1km_year1994",
    "max_topography_srtm_relative_alt_5km_year1994",
    "min_topography_srtm_relative_alt_5km_year1994",
    "stddev_topography_srtm_relative_alt_5km_year1994",
]
ROAD = "distance_to_major_road_year2020"
LANDCOVER = "dominant_landcover_year2012"
SRTM_90M = "mean_topography_srtm_alt_90m_year1994"
LABEL_COLUMNS = [TARGET, "type_of_area_source", "type_of_area_toar", "type_of_area_gmap", "type_of_area_pred"]

SENTINELS = [-999.0, -9999.0]
ALTITUDE_SENTINEL = 9999.0

TIMEZONE_REGIONS = {
    "Africa": "Africa",
    "America": "America",
    "Europe": "Europe",
    "Asia": "Asia",
    "Antarctica": "Antarctica",
    "Australia": "Australia",
    "Pacific": "Pacific",
    "N": "N",
    "UTC": "UTC",
    "Indian": "Indian",
    "Atlantic": "Atlantic",
    "Canada": "America",
    "CET": "Europe",
    "Arctic": "Europe",
    "EST": "America",
    "Turkey": "Europe",
    "Etc": "UTC",
}

NOT_SCORED = "not enough data for prediction"

# End of fixed values.

ROW_ID = "row_id"
KEYS = ["lat", "lon"]


def _typed(name: str) -> T.StructField:
    kind = T.StringType() if name in CATEGORICAL else T.DoubleType()
    return T.StructField(name, kind, True)


BASE_FIELDS = ["lat", "lon", "area_code", "timezone", TARGET, "altitude"]
STATION_SCHEMA = T.StructType([_typed(c) for c in [*BASE_FIELDS, *METADATA_FIELDS]])
SPECIES_SCHEMA = T.StructType([_typed(c) for c in ["lat", "lon", "value"]])


def present(df: DataFrame, names: list[str]) -> list[str]:
    """The names a frame actually has, in the order given."""
    have = set(df.columns)
    return [c for c in names if c in have]


def numeric_columns(df: DataFrame, among: list[str] | None = None) -> list[str]:
    """Columns of a numeric type, restricted to ``among`` when given."""
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return found if among is None else [c for c in found if c in set(among)]


def string_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Columns of string type, less those named in ``without``."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in without
    ]


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that are neither identity nor one of the known label columns."""
    return [c for c in df.columns if c not in (ROW_ID, *ID_COLUMNS, *LABEL_COLUMNS)]
