"""Station-shaped tables derived from the driver's tables.

Each one is built by Spark from whole input tables. ``BLOCKS`` holds the same
definition as SQL text, so that the oracle reads identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per customer, with duplicates, sentinels, nulls and coded text."""
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_ord"),
        F.max("o_totalprice").alias("mx"),
        F.min("o_totalprice").alias("mn"),
    )
    base = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(per_customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .withColumn("n_ord", F.coalesce("n_ord", F.lit(0)))
        .withColumn("k", F.col("c_custkey"))
    )
    k = F.col("k")
    n_ord = F.col("n_ord")
    shared = F.when(k % 11 == 10, k - 1).otherwise(k)
    cents = lambda c: c.cast("double") / 100
    num = lambda v: F.lit(float(v))
    region = F.col("r_name")
    return base.select(
        k.alias(S.ROW_ID),
        cents((shared * 37) % 18000 - 9000).alias("lat"),
        cents((shared * 91) % 36000 - 18000).alias("lon"),
        F.concat(F.lit("ST"), F.lpad(k.cast("string"), 7, "0")).alias("area_code"),
        F.when(k % 13 == 0, "Mars/Base").when(region == "AFRICA", "Africa/Nairobi")
        .when(region == "AMERICA", "Canada/Pacific").when(region == "EUROPE", "CET")
        .when(region == "ASIA", " Asia /Tokyo").otherwise("Turkey").alias("timezone"),
        F.when(k % 5 == 0, "unknown").when(n_ord >= 12, "urban")
        .when(n_ord >= 8, "suburban").otherwise("rural").alias(S.TARGET),
        F.when(k % 17 == 0, num(9999)).when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, num(-999))
        .otherwise(F.col("c_acctbal")).alias("altitude"),
        F.when(k % 31 != 0, F.col("c_acctbal") / 2).alias(S.SRTM_90M),
        F.when(k % 37 == 0, num(-1)).otherwise(F.col("mn")).alias(S.ROAD),
        F.when(k % 41 == 0, num(-9999)).otherwise(F.col("mx"))
        .alias("mean_population_density_5km_year2015"),
        F.when(k % 71 != 0, n_ord.cast("double")).alias("mean_stable_nightlights_5km_year2013"),
        F.when(k % 43 == 0, F.lit(None)).when(k % 53 == 0, "-999 none")
        .otherwise(F.concat(
            ((F.col("n_nationkey") * 5) % 21 * 10 + k % 3).cast("string"), F.lit(" Cover class")))
        .alias(S.LANDCOVER),
        F.when(k % 47 != 0, F.concat((F.col("n_nationkey") % 12).cast("string"), F.lit(" Zone")))
        .alias("climatic_zone_year2016"),
    )


def hand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second opinion on the labelled stations of one time zone."""
    st = stations_raw(spark, sf_dir)
    return st.where((F.col("timezone") == "CET") & (F.col(S.TARGET) != S.UNLABELLED)).select(
        "lat", "lon", "area_code", F.col(S.TARGET).alias("type_of_area_source"),
        F.when(F.col("altitude") < 0, "suburban").otherwise(F.col(S.TARGET)).alias("type_of_area_gmap"),
    )


def species_no2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A species statistic with nulls and duplicate coordinates."""
    return stations_raw(spark, sf_dir).where(F.col("timezone") != "Turkey").select(
        "lat", "lon", F.col("mean_population_density_5km_year2015").alias("value"))


def species_nox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second species statistic that covers other stations."""
    return stations_raw(spark, sf_dir).where(F.col("timezone") != "Mars/Base").select(
        "lat", "lon", F.col(S.ROAD).alias("value"))


def requested_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes somebody asks for, one per supplier, some of which do not exist."""
    tail = F.lpad(F.col("s_suppkey").cast("string"), 7, "0")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("pos"),
        F.concat(F.when(F.col("s_acctbal") < 0, "XX").otherwise("ST"), tail).alias("area_code"),
    )


def class_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities as exact binary fractions, so ties are exact too."""
    a, b = (F.col(S.ROW_ID) * 7) % 33, (F.col(S.ROW_ID) * 13) % 32
    part = lambda c: c.cast("double") / 64
    return stations_raw(spark, sf_dir).select(
        S.ROW_ID, S.TARGET, part(a).alias("p_rural"), part(b).alias("p_suburban"),
        part(F.lit(64) - a - b).alias("p_urban"))


def model_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four deterministic members that disagree."""
    k, label = F.col(S.ROW_ID), F.col(S.TARGET)
    st = stations_raw(spark, sf_dir).where(label != S.UNLABELLED)
    return st.select(
        S.ROW_ID, S.TARGET,
        F.when(k % 3 == 0, "rural").when(k % 3 == 1, "suburban").otherwise("urban").alias("pred_rf"),
        F.when(k % 4 == 0, "urban").when(k % 4 == 1, "rural").otherwise(label).alias("pred_catboost"),
        F.when(k % 5 == 0, "suburban").when(k % 5 == 1, "urban").otherwise(label).alias("pred_lgbm"),
        F.when(k % 7 == 0, "rural").when(k % 7 == 1, "suburban").otherwise(label).alias("pred_xgb"),
    )


def api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON records, some without coordinates, codes or metadata."""
    k = F.col(S.ROW_ID)
    text = lambda c: F.col(c).cast("string")
    coordinates = F.when(k % 67 == 0, "").otherwise(F.concat(
        F.lit('"coordinates":{"lat":'), text("lat"), F.lit(',"lng":'), text("lon"), F.lit(',"alt":'),
        F.when(k % 19 == 0, "null").otherwise(text(S.ROW_ID)), F.lit("},")))
    codes = F.when(k % 61 == 0, '"codes":[],').otherwise(F.concat(
        F.lit('"codes":["'), F.col("area_code"), F.lit('","ALT'), text(S.ROW_ID), F.lit('"],')))
    zone = F.col("climatic_zone_year2016")
    meta = F.when(zone.isNull(), "").otherwise(
        F.concat(F.lit('"climatic_zone_year2016":"'), zone, F.lit('"')))
    return stations_raw(spark, sf_dir).select(S.ROW_ID, F.concat(
        F.lit("{"), coordinates, codes, F.lit('"timezone":"'), F.col("timezone"),
        F.lit('","type_of_area":"'), F.col(S.TARGET), F.lit('","globalmeta":{'), meta, F.lit("}}"),
    ).alias("body"))


BLOCKS = {
    "stations_raw": """
WITH o AS (
  SELECT o_custkey, COUNT(*) AS n_ord, MAX(o_totalprice) AS mx, MIN(o_totalprice) AS mn
  FROM orders GROUP BY o_custkey),
b AS (
  SELECT c.c_custkey AS k,
         CASE WHEN c.c_custkey % 11 = 10 THEN c.c_custkey - 1 ELSE c.c_custkey END AS kk,
         c.c_acctbal, n.n_nationkey, r.r_name, COALESCE(o.n_ord, 0) AS n_ord, o.mx, o.mn
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN o ON o.o_custkey = c.c_custkey)
SELECT k AS row_id,
  CAST(((kk * 37) % 18000) - 9000 AS DOUBLE) / 100 AS lat,
  CAST(((kk * 91) % 36000) - 18000 AS DOUBLE) / 100 AS lon,
  CONCAT('ST', LPAD(CAST(k AS VARCHAR), 7, '0')) AS area_code,
  CASE WHEN k % 13 = 0 THEN 'Mars/Base' WHEN r_name = 'AFRICA' THEN 'Africa/Nairobi'
       WHEN r_name = 'AMERICA' THEN 'Canada/Pacific' WHEN r_name = 'EUROPE' THEN 'CET'
       WHEN r_name = 'ASIA' THEN ' Asia /Tokyo' ELSE 'Turkey' END AS timezone,
  CASE WHEN k % 5 = 0 THEN 'unknown' WHEN n_ord >= 12 THEN 'urban'
       WHEN n_ord >= 8 THEN 'suburban' ELSE 'rural' END AS type_of_area,
  CASE WHEN k % 17 = 0 THEN CAST(9999 AS DOUBLE) WHEN k % 19 = 0 THEN NULL
       WHEN k % 23 = 0 THEN CAST(-999 AS DOUBLE) ELSE c_acctbal END AS altitude,
  CASE WHEN k % 31 = 0 THEN NULL ELSE c_acctbal / 2 END AS mean_topography_srtm_alt_90m_year1994,
  CASE WHEN k % 37 = 0 THEN CAST(-1 AS DOUBLE) ELSE mn END AS distance_to_major_road_year2020,
  CASE WHEN k % 41 = 0 THEN CAST(-9999 AS DOUBLE) ELSE mx END AS mean_population_density_5km_year2015,
  CASE WHEN k % 71 = 0 THEN NULL ELSE CAST(n_ord AS DOUBLE) END AS mean_stable_nightlights_5km_year2013,
  CASE WHEN k % 43 = 0 THEN NULL WHEN k % 53 = 0 THEN '-999 none'
       ELSE CONCAT(CAST((n_nationkey * 5) % 21 * 10 + k % 3 AS VARCHAR), ' Cover class') END
    AS dominant_landcover_year2012,
  CASE WHEN k % 47 = 0 THEN NULL ELSE CONCAT(CAST(n_nationkey % 12 AS VARCHAR), ' Zone') END
    AS climatic_zone_year2016
FROM b""",
    "hand_labels": """
SELECT lat, lon, area_code, type_of_area AS type_of_area_source,
       CASE WHEN altitude < 0 THEN 'suburban' ELSE type_of_area END AS type_of_area_gmap
FROM stations_raw WHERE timezone = 'CET' AND type_of_area <> 'unknown'""",
    "species_no2": """
SELECT lat, lon, mean_population_density_5km_year2015 AS value
FROM stations_raw WHERE timezone <> 'Turkey'""",
    "species_nox": """
SELECT lat, lon, distance_to_major_road_year2020 AS value
FROM stations_raw WHERE timezone <> 'Mars/Base'""",
    "requested_codes": """
SELECT s_suppkey AS pos,
       CONCAT(CASE WHEN s_acctbal < 0 THEN 'XX' ELSE 'ST' END,
              LPAD(CAST(s_suppkey AS VARCHAR), 7, '0')) AS area_code
FROM supplier""",
    "class_probs": """
SELECT row_id, type_of_area, CAST(a AS DOUBLE) / 64 AS p_rural, CAST(b AS DOUBLE) / 64 AS p_suburban,
       CAST(64 - a - b AS DOUBLE) / 64 AS p_urban
FROM (SELECT row_id, type_of_area, (row_id * 7) % 33 AS a, (row_id * 13) % 32 AS b FROM stations_raw) q""",
    "model_votes": """
SELECT row_id, type_of_area,
  CASE row_id % 3 WHEN 0 THEN 'rural' WHEN 1 THEN 'suburban' ELSE 'urban' END AS pred_rf,
  CASE row_id % 4 WHEN 0 THEN 'urban' WHEN 1 THEN 'rural' ELSE type_of_area END AS pred_catboost,
  CASE row_id % 5 WHEN 0 THEN 'suburban' WHEN 1 THEN 'urban' ELSE type_of_area END AS pred_lgbm,
  CASE row_id % 7 WHEN 0 THEN 'rural' WHEN 1 THEN 'suburban' ELSE type_of_area END AS pred_xgb
FROM stations_raw WHERE type_of_area <> 'unknown'""",
    "api_records": """
SELECT row_id, CONCAT('{',
  CASE WHEN row_id % 67 = 0 THEN '' ELSE CONCAT('"coordinates":{"lat":', CAST(lat AS VARCHAR), ',"lng":',
       CAST(lon AS VARCHAR), ',"alt":', CASE WHEN row_id % 19 = 0 THEN 'null' ELSE CAST(row_id AS VARCHAR) END, '},') END,
  CASE WHEN row_id % 61 = 0 THEN '"codes":[],' ELSE CONCAT('"codes":["', area_code, '","ALT', CAST(row_id AS VARCHAR), '"],') END,
  '"timezone":"', timezone, '","type_of_area":"', type_of_area, '","globalmeta":{',
  CASE WHEN climatic_zone_year2016 IS NULL THEN '' ELSE CONCAT('"climatic_zone_year2016":"', climatic_zone_year2016, '"') END,
  '}}') AS body
FROM stations_raw""",
}


def with_blocks(body: str, *names: str, **extra: str) -> str:
    """``body`` with the named blocks, and any extra ones, in front as CTEs."""
    order = ["stations_raw", *[n for n in names if n != "stations_raw"]]
    parts = [f"{n} AS ({BLOCKS[n]})" for n in order]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
