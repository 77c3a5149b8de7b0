"""Queries for projections, filters, joins, deduplication, scalar functions and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationloom import fixtures as X
from stationloom import schema as S
from stationloom.fixtures import with_blocks
from stationloom.functions import cleaning as C
from stationloom.functions import numeric as N
from stationloom.functions import voting as V
from stationloom.operators import rows as R
from stationloom.operators import transforms as L
from stationloom.plans import cleaning as P
from stationloom.registry.base import GATE_HERE, REGION_SQL, over_clean, query
from stationloom.sources.csv_files import species_table
from stationloom.sources.sinks import date_stamp

MEMBERS = ["rf", "catboost", "lgbm", "xgb"]
PREDS = [f"pred_{m}" for m in MEMBERS]
NUM = "CAST({} AS DOUBLE)"


def _decoded(spark, d):
    return P.before_gate(X.stations_raw(spark, d))


def clean(spark, d):
    """Cleaned stations without imputation."""
    return P.finish(P.structural(X.stations_raw(spark, d)))


def marked(spark, d):
    """All stations, cleaned without imputation, those dropped by cleaning unmarked."""
    return P.finish(P.structural(R.marked(X.stations_raw(spark, d))))


# -- P: projections and filters ---------------------------------------------------------


@query("p1_select_columns", with_blocks("SELECT area_code, lat, altitude FROM stations_raw"))
def p1(spark, d):
    return R.keep_columns(X.stations_raw(spark, d), ["area_code", "no_such_column", "lat", "altitude"])


@query("p2_sentinels_to_null", over_clean(
    "SELECT row_id, altitude, mean_population_density_5km_year2015, dominant_landcover_year2012 FROM decoded",
    upto="decoded"))
def p2(spark, d):
    return _decoded(spark, d).select(S.ROW_ID, "altitude", GATE_HERE[1], S.LANDCOVER)


@query("p3_missing_gate_any", over_clean("SELECT row_id FROM gated", upto="gated"))
def p3_any(spark, d):
    return R.gate_missing(_decoded(spark, d)).select(S.ROW_ID)


@query("p3_missing_gate_all", over_clean(
    f"SELECT row_id FROM decoded WHERE {GATE_HERE[0]} IS NOT NULL OR {GATE_HERE[1]} IS NOT NULL", upto="decoded"))
def p3_all(spark, d):
    return R.gate_missing(_decoded(spark, d), mode="all").select(S.ROW_ID)


@query("p4_cross_fill", over_clean(
    f"SELECT row_id, altitude, {S.SRTM_90M} FROM structural", upto="structural"))
def p4(spark, d):
    return P.structural(X.stations_raw(spark, d)).select(S.ROW_ID, "altitude", S.SRTM_90M)


@query("p5_road_range", over_clean(f"SELECT row_id, {S.ROAD} FROM structural WHERE {S.ROAD} >= 0", upto="structural"))
def p5(spark, d):
    return R.road_in_range(P.structural(X.stations_raw(spark, d))).select(S.ROW_ID, S.ROAD)


@query("p6_categories_to_text", over_clean(
    "SELECT row_id, timezone, climatic_zone_year2016, dominant_landcover_year2012 FROM cleaned"))
def p6(spark, d):
    return clean(spark, d).select(S.ROW_ID, "timezone", "climatic_zone_year2016", S.LANDCOVER)


@query("p7_labelled", with_blocks("SELECT row_id, type_of_area FROM stations_raw WHERE type_of_area <> 'unknown'"))
def p7a(spark, d):
    return R.split_labelled(X.stations_raw(spark, d))[0].select(S.ROW_ID, S.TARGET)


@query("p7_unlabelled", with_blocks("SELECT row_id, type_of_area FROM stations_raw WHERE type_of_area = 'unknown'"))
def p7b(spark, d):
    return R.split_labelled(X.stations_raw(spark, d))[1].select(S.ROW_ID, S.TARGET)


@query("p8_identifiers", with_blocks("SELECT row_id, lat, lon, area_code, type_of_area FROM stations_raw"))
def p8(spark, d):
    return R.identifiers(X.stations_raw(spark, d))


@query("p9_align_features", with_blocks(
    f"SELECT row_id, {S.ROAD}, CAST(0 AS DOUBLE) AS mean_nox_emissions_10km_year2015, altitude FROM stations_raw"))
def p9(spark, d):
    wanted = [S.ROAD, "mean_nox_emissions_10km_year2015", "altitude"]
    return R.align_features(X.stations_raw(spark, d), wanted, carry=[S.ROW_ID])


@query("p10_predictors", with_blocks("SELECT * EXCLUDE (area_code, type_of_area) FROM stations_raw"))
def p10(spark, d):
    return R.predictors(X.stations_raw(spark, d), ["area_code", S.TARGET, "type_of_area_gmap"])


@query("p11_numeric_columns", with_blocks(
    f"SELECT row_id, altitude, {S.SRTM_90M}, {S.ROAD}, {GATE_HERE[1]}, {GATE_HERE[0]} FROM stations_raw"))
def p11(spark, d):
    df = X.stations_raw(spark, d)
    return df.select(S.ROW_ID, *S.numeric_columns(df, S.NUMERIC))


@query("p12_string_columns", with_blocks(
    "SELECT row_id, timezone, type_of_area, dominant_landcover_year2012, climatic_zone_year2016 FROM stations_raw"))
def p12(spark, d):
    df = X.stations_raw(spark, d)
    return df.select(S.ROW_ID, *S.string_columns(df, without=("area_code",)))


@query("p13_cluster_labels", """
SELECT vec_id, CASE label WHEN 0 THEN 'rural' WHEN 1 THEN 'suburban' WHEN 2 THEN 'urban' END AS name FROM embeddings""")
def p13(spark, d):
    names = {i: c for i, c in enumerate(S.CLASSES)}
    df = X.table(spark, d, "embeddings").select("vec_id", "label")
    return R.map_clusters(df, names, "label", "name").select("vec_id", "name")


_SURVIVORS = over_clean(
    "SELECT s.row_id, s.area_code, CASE WHEN c.row_id IS NULL THEN 'not enough data for prediction' "
    "ELSE v.pred END AS pred_lgbm FROM stations_raw s LEFT JOIN cleaned c ON s.row_id = c.row_id "
    "LEFT JOIN votes v ON s.row_id = v.row_id",
    votes="SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'suburban' WHEN 1 THEN 'urban' ELSE type_of_area END AS pred "
          "FROM stations_raw")


@query("p14_not_scored_message", _SURVIVORS)
def p14(spark, d):
    k = F.col(S.ROW_ID)
    pred = F.when(k % 5 == 0, "suburban").when(k % 5 == 1, "urban").otherwise(F.col(S.TARGET))
    scored = R.handed_back(marked(spark, d).withColumn("pred_lgbm", pred), ["pred_lgbm"])
    return R.fill_not_scored(scored, ["pred_lgbm"]).select(S.ROW_ID, "area_code", "pred_lgbm")


@query("p15_class_masks", with_blocks("""
SELECT count(*) FILTER (WHERE type_of_area = 'rural') AS rural, count(*) FILTER (WHERE type_of_area = 'suburban')
  AS suburban, count(*) FILTER (WHERE type_of_area = 'urban') AS urban FROM stations_raw"""))
def p15(spark, d):
    return X.stations_raw(spark, d).agg(*[F.count_if(F.col(S.TARGET) == c).alias(c) for c in S.CLASSES])


@query("p16_output_columns", with_blocks("SELECT row_id, pred_lgbm FROM model_votes", "model_votes"))
def p16(spark, d):
    from stationloom.plans.scoring import output_columns
    return X.model_votes(spark, d).select(S.ROW_ID, *output_columns(MEMBERS, "lgbm"))


@query("p17_tagged_points", with_blocks("SELECT lat, lon, 'train' AS split FROM stations_raw"))
def p17(spark, d):
    return R.tagged_points(X.stations_raw(spark, d), "train")


# -- J: joins -------------------------------------------------------------------------

_SPECIES = {
    "no2": "SELECT lat, lon, max(value) AS no2 FROM species_no2 GROUP BY lat, lon HAVING count(*) = 1 AND max(value) IS NOT NULL",
    "nox": "SELECT lat, lon, max(value) AS nox FROM species_nox GROUP BY lat, lon HAVING count(*) = 1 AND max(value) IS NOT NULL",
}
SPECIES_BLOCKS = ("species_no2", "species_nox")


def species(spark, d):
    """Both species tables without ambiguous coordinates."""
    return [species_table(getattr(X, f"species_{n}")(spark, d), n) for n in ("no2", "nox")]


@query("j1_species_join", with_blocks(
    "SELECT no2.lat, no2.lon, no2, nox FROM no2 JOIN nox ON no2.lat = nox.lat AND no2.lon = nox.lon",
    *SPECIES_BLOCKS, **_SPECIES))
def j1(spark, d):
    return R.join_species(species(spark, d))


@query("j2_features_species", over_clean(
    "SELECT row_id, c.lat, c.lon, altitude, no2 FROM cleaned c JOIN no2 ON c.lat = no2.lat AND c.lon = no2.lon",
    "species_no2", no2=_SPECIES["no2"]))
def j2(spark, d):
    joined = R.join_on_keys(clean(spark, d), species(spark, d)[0])
    return joined.select(S.ROW_ID, "lat", "lon", "altitude", "no2")


@query("j3_hand_label_semi", over_clean("""
SELECT row_id, area_code FROM cleaned c WHERE type_of_area <> 'unknown'
AND EXISTS (SELECT 1 FROM hand_labels h WHERE h.lat = c.lat AND h.lon = c.lon)""", "hand_labels"))
def j3(spark, d):
    labelled = R.split_labelled(clean(spark, d))[0]
    return R.join_on_keys(labelled, X.hand_labels(spark, d), "left_semi").select(S.ROW_ID, "area_code")


@query("j4_hand_label_anti", over_clean("""
SELECT row_id, area_code FROM cleaned c WHERE type_of_area <> 'unknown'
AND NOT EXISTS (SELECT 1 FROM hand_labels h WHERE h.lat = c.lat AND h.lon = c.lon)""", "hand_labels"))
def j4(spark, d):
    labelled = R.split_labelled(clean(spark, d))[0]
    return R.join_on_keys(labelled, X.hand_labels(spark, d), "left_anti").select(S.ROW_ID, "area_code")


@query("j5_attach_identifiers", over_clean("""
SELECT s.row_id, s.lat, s.lon, s.area_code, s.type_of_area, c.altitude, c.row_id IS NOT NULL AS survived
FROM stations_raw s LEFT JOIN cleaned c ON s.row_id = c.row_id"""))
def j5(spark, d):
    return R.handed_back(marked(spark, d), [F.when(F.col(R.MARK), F.col("altitude")).alias("altitude")])


@query("j6_dropped_rows", over_clean("""
SELECT s.row_id, s.area_code FROM stations_raw s WHERE s.row_id NOT IN (SELECT row_id FROM cleaned)"""))
def j6(spark, d):
    return R.handed_back(marked(spark, d), []).where("NOT survived").select(S.ROW_ID, "area_code")


@query("j8_timezone_lookup", with_blocks(f"SELECT row_id, {REGION_SQL} AS region FROM stations_raw"))
def j8(spark, d):
    key = F.trim(F.substring_index("timezone", "/", 1))
    return X.stations_raw(spark, d).select(S.ROW_ID, C.lookup(key, S.TIMEZONE_REGIONS).alias("region"))


@query("j9_reserved_rows", over_clean("""
SELECT row_id, area_code FROM cleaned c WHERE type_of_area <> 'unknown'
AND EXISTS (SELECT 1 FROM hand_labels h WHERE h.lat = c.lat AND h.lon = c.lon)""", "hand_labels"))
def j9(spark, d):
    from stationloom.operators.sampling import split_for_training
    return split_for_training(clean(spark, d), hand_labels=X.hand_labels(spark, d))[2].select(S.ROW_ID, "area_code")


# -- D: deduplication -------------------------------------------------------------------


@query("d1_keep_first", over_clean("SELECT * EXCLUDE (place) FROM first_rows", upto="first_rows"))
def d1(spark, d):
    return R.keep_first(X.stations_raw(spark, d))


@query("d2_duplicate_rows", with_blocks("""
SELECT row_id, lat, lon FROM (SELECT *, count(*) OVER (PARTITION BY lat, lon) AS n FROM stations_raw) q WHERE n > 1"""))
def d2(spark, d):
    return R.duplicate_rows(X.stations_raw(spark, d)).select(S.ROW_ID, "lat", "lon")


@query("d3_drop_all_duplicates", with_blocks("""
SELECT lat, lon, value FROM (SELECT *, count(*) OVER (PARTITION BY lat, lon) AS n FROM species_no2) q WHERE n = 1""",
       "species_no2"))
def d3(spark, d):
    return R.drop_all_duplicates(X.species_no2(spark, d), "value")


@query("d4_union_all", with_blocks("""
SELECT area_code, type_of_area, row_id FROM stations_raw UNION ALL
SELECT area_code, type_of_area_source, NULL FROM hand_labels""", "hand_labels"))
def d4(spark, d):
    hand = X.hand_labels(spark, d).select("area_code", F.col("type_of_area_source").alias(S.TARGET))
    return R.union_all(X.stations_raw(spark, d).select("area_code", S.TARGET, S.ROW_ID), hand)


@query("d5_position_difference", over_clean("SELECT row_id FROM stations_raw EXCEPT SELECT row_id FROM cleaned"))
def d5(spark, d):
    return X.stations_raw(spark, d).select(S.ROW_ID).join(clean(spark, d), S.ROW_ID, "left_anti")


@query("d6_key_intersection", with_blocks(
    "SELECT lat, lon FROM hand_labels INTERSECT SELECT lat, lon FROM species_nox", "hand_labels", "species_nox"))
def d6(spark, d):
    return X.hand_labels(spark, d).select(*S.KEYS).intersect(X.species_nox(spark, d).select(*S.KEYS))


@query("d7_distinct_values", over_clean(
    "SELECT DISTINCT dominant_landcover_year2012 AS code FROM decoded", upto="decoded"))
def d7(spark, d):
    return _decoded(spark, d).select(F.col(S.LANDCOVER).alias("code")).distinct()


# -- T: sorting and top-k -----------------------------------------------------------------


@query("t2_argmax", with_blocks("""
SELECT row_id, CASE WHEN p_rural >= p_suburban AND p_rural >= p_urban THEN 0
  WHEN p_suburban >= p_urban THEN 1 ELSE 2 END AS top FROM class_probs""", "class_probs"))
def t2(spark, d):
    return X.class_probs(spark, d).select(S.ROW_ID, V.argmax(F.array(*[f"p_{c}" for c in S.CLASSES])).alias("top"))


VOTE_SQL = """
SELECT row_id, vote AS voting FROM (
  SELECT row_id, vote, row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, min(seat)) AS place FROM (
    SELECT row_id, pred_rf AS vote, 1 AS seat FROM model_votes UNION ALL
    SELECT row_id, pred_catboost, 2 FROM model_votes UNION ALL
    SELECT row_id, pred_lgbm, 3 FROM model_votes UNION ALL
    SELECT row_id, pred_xgb, 4 FROM model_votes) b
  GROUP BY row_id, vote) r
WHERE place = 1"""


@query("t3_vote", with_blocks(VOTE_SQL, "model_votes"))
def t3(spark, d):
    return X.model_votes(spark, d).select(S.ROW_ID, V.majority(F.array(*PREDS)).alias("voting"))


@query("t5_preview", with_blocks("SELECT row_id, area_code FROM stations_raw ORDER BY row_id LIMIT 5"))
def t5(spark, d):
    return X.stations_raw(spark, d).select(S.ROW_ID, "area_code").orderBy(S.ROW_ID).limit(5)


# -- X: scalar functions ------------------------------------------------------------------


@query("x1_code_prefix", with_blocks("""
SELECT row_id, CAST(split_part(dominant_landcover_year2012, ' ', 1) AS DOUBLE) AS landcover,
  CAST(split_part(climatic_zone_year2016, ' ', 1) AS DOUBLE) AS climate FROM stations_raw"""))
def x1(spark, d):
    return X.stations_raw(spark, d).select(
        S.ROW_ID, C.code_of(F.col(S.LANDCOVER)).alias("landcover"),
        C.code_of(F.col("climatic_zone_year2016")).alias("climate"))


@query("x2_timezone", with_blocks(f"SELECT row_id, {REGION_SQL} AS timezone FROM stations_raw"))
def x2(spark, d):
    return X.stations_raw(spark, d).select(S.ROW_ID, C.timezone_region(F.col("timezone")).alias("timezone"))


@query("x3_landcover_parent", with_blocks("""
SELECT row_id, floor(CAST(split_part(dominant_landcover_year2012, ' ', 1) AS DOUBLE) / 10) * 10 AS parent
FROM stations_raw"""))
def x3(spark, d):
    return X.stations_raw(spark, d).select(
        S.ROW_ID, C.landcover_parent(C.code_of(F.col(S.LANDCOVER))).alias("parent"))


@query("x4_tidy_category", over_clean("""
SELECT row_id, regexp_replace(trim(climatic_zone_year2016), '\\.0$', '') AS climate,
  regexp_replace(trim(dominant_landcover_year2012), '\\.0$', '') AS landcover FROM cleaned"""))
def x4(spark, d):
    return clean(spark, d).select(
        S.ROW_ID, C.tidy_category(F.col("climatic_zone_year2016")).alias("climate"),
        C.tidy_category(F.col(S.LANDCOVER)).alias("landcover"))


@query("x6_lenient_number", with_blocks("""
SELECT row_id, TRY_CAST(dominant_landcover_year2012 AS DOUBLE) AS text_number,
  TRY_CAST(CASE WHEN timezone = 'CET' THEN substr(area_code, 3) ELSE timezone END AS DOUBLE) AS tail
FROM stations_raw"""))
def x6(spark, d):
    tail = F.when(F.col("timezone") == "CET", F.substring("area_code", 3, 20)).otherwise(F.col("timezone"))
    return X.stations_raw(spark, d).select(
        S.ROW_ID, C.lenient_number(F.col(S.LANDCOVER)).alias("text_number"), C.lenient_number(tail).alias("tail"))


@query("x7_clip", with_blocks("""
SELECT row_id, CASE WHEN altitude < 0 THEN 0 WHEN altitude > 5000 THEN 5000 ELSE altitude END AS altitude
FROM stations_raw"""))
def x7(spark, d):
    return X.stations_raw(spark, d).select(S.ROW_ID, N.clip(F.col("altitude"), 0.0, 5000.0).alias("altitude"))


def _yj_sql(c: str, lam: float) -> str:
    up = f"ln(1 + {c})" if lam == 0 else f"(pow({c} + 1, {lam}) - 1) / {lam}"
    down = f"-ln(1 - {c})" if lam == 2 else f"-(pow(1 - {c}, {2 - lam}) - 1) / {2 - lam}"
    return f"round(CASE WHEN {c} >= 0 THEN {up} ELSE {down} END, 4)"


_LAMBDAS = {"half": 0.5, "zero": 0.0, "two": 2.0, "minus": -0.3}


@query("x8_yeo_johnson", "SELECT c_custkey, " + ", ".join(
    f"{_yj_sql('(c_acctbal / 1000)', lam)} AS {n}" for n, lam in _LAMBDAS.items()) + " FROM customer")
def x8(spark, d):
    x = F.col("c_acctbal") / 1000
    return X.table(spark, d, "customer").select(
        "c_custkey", *[F.round(N.yeo_johnson(x, lam), 4).alias(n) for n, lam in _LAMBDAS.items()])


@query("x9_shift_scale", "SELECT o_orderkey, round((o_totalprice - 1000) / 250, 6) AS scaled FROM orders")
def x9(spark, d):
    return X.table(spark, d, "orders").select(
        "o_orderkey", F.round(N.shift_scale(F.col("o_totalprice"), 1000.0, 250.0), 6).alias("scaled"))


_TOP_LOW = ("CASE WHEN p_rural >= p_suburban AND p_rural >= p_urban THEN 'rural' "
            "WHEN p_suburban >= p_urban THEN 'suburban' ELSE 'urban' END")
_TOP_SUB = ("CASE WHEN p_suburban >= p_rural AND p_suburban >= p_urban THEN 'suburban' "
            "WHEN p_rural >= p_urban THEN 'rural' ELSE 'urban' END")
_P_MAX = "greatest(p_rural, p_suburban, p_urban)"


def _rule_sql(top: str, thd: float, out: str) -> str:
    return (f"SELECT row_id, CASE WHEN {top} = 'suburban' OR {_P_MAX} >= {thd} THEN {top} ELSE 'suburban' END AS {out} "
            "FROM class_probs")


def probabilities():
    """Class probabilities in class order."""
    return F.array(*[f"p_{c}" for c in S.CLASSES])


@query("x10_confident_class", with_blocks(_rule_sql(_TOP_LOW, 0.5, "pred"), "class_probs"))
def x10(spark, d):
    return X.class_probs(spark, d).select(S.ROW_ID, V.confident_class(probabilities(), 0.5).alias("pred"))


@query("x11_confident_class_suburban_first", with_blocks(_rule_sql(_TOP_SUB, 0.45, "pred"), "class_probs"))
def x11(spark, d):
    return X.class_probs(spark, d).select(
        S.ROW_ID, V.confident_class_suburban_first(probabilities(), 0.45).alias("pred"))


@query("x12_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x12(spark, d):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return X.table(spark, d, "events").select("event_id", k.alias("k"))


@query("x13_row_vote", with_blocks(
    "SELECT row_id, CASE WHEN pred_lgbm = pred_xgb THEN pred_lgbm ELSE pred_rf END AS voting FROM model_votes",
    "model_votes"))
def x13(spark, d):
    three = F.array("pred_rf", "pred_lgbm", "pred_xgb")
    return X.model_votes(spark, d).select(S.ROW_ID, V.majority(three).alias("voting"))


@query("x14_label_codes", with_blocks("""
SELECT row_id, CASE type_of_area WHEN 'rural' THEN 0 WHEN 'suburban' THEN 1 WHEN 'urban' THEN 2 END AS code,
  type_of_area AS decoded FROM stations_raw WHERE type_of_area <> 'unknown'"""))
def x14(spark, d):
    df = R.split_labelled(X.stations_raw(spark, d))[0].select(S.ROW_ID, S.TARGET)
    levels = L.sorted_levels(df, [S.TARGET])
    names = F.array(*[F.lit(v) for v in levels[S.TARGET]])
    coded = L.label_codes(df, levels).withColumnRenamed(S.TARGET, "code")
    return coded.withColumn("decoded", F.element_at(names, F.col("code") + 1))


@query("x15_date_stamp", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS stamp FROM orders")
def x15(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", date_stamp(F.col("o_orderdate")).alias("stamp"))
