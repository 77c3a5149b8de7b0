"""Queries for aggregates, sampling, learned columns, metrics and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationloom import fixtures as X
from stationloom import schema as S
from stationloom.fixtures import with_blocks
from stationloom.functions import voting as V
from stationloom.operators import impute as I
from stationloom.operators import metrics as M
from stationloom.operators import rows as R
from stationloom.operators import sampling as SP
from stationloom.operators import summaries as A
from stationloom.operators import transforms as L
from stationloom.plans import cleaning as P
from stationloom.registry.base import CODED_HERE, GATE_HERE, NUMERIC_HERE, over_clean, query
from stationloom.registry.rows import (
    _SPECIES, _TOP_SUB, PREDS, SPECIES_BLOCKS, VOTE_SQL, clean, probabilities, species,
)
from stationloom.session import scratch_path
from stationloom.sources import csv_files, inputs, paged, records, sinks

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, digits=6, skip=()):
    """Doubles rounded for comparison."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def constants(spark, names, rows, kinds):
    """Learned constants as a table."""
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


# -- A: aggregates ------------------------------------------------------------------------


@query("a1_row_counts", with_blocks("""
SELECT count(*) AS total, count(*) FILTER (WHERE type_of_area <> 'unknown') AS labelled,
  count(*) FILTER (WHERE type_of_area = 'unknown') AS unlabelled FROM stations_raw"""))
def a1(spark, d):
    return A.size_report(X.stations_raw(spark, d))


@query("a1_cleaning_audit", over_clean(f"""
SELECT 'duplicates' AS step, (SELECT count(*) FROM stations_raw) AS rows_in, (SELECT count(*) FROM decoded) AS rows_out
UNION ALL SELECT 'missing_gate', (SELECT count(*) FROM decoded), (SELECT count(*) FROM gated)
UNION ALL SELECT 'road_distance', (SELECT count(*) FROM gated), (SELECT count(*) FROM gated WHERE {S.ROAD} >= 0)""",
       upto="gated"))
def a1_audit(spark, d):
    return P.audit(X.stations_raw(spark, d))


@query("a2_class_counts", over_clean("SELECT type_of_area, count(*) AS n FROM cleaned GROUP BY 1"))
def a2(spark, d):
    return A.value_counts(clean(spark, d), S.TARGET)


_TEST_SQL = """
SELECT row_id, type_of_area FROM (
  SELECT l.*, row_number() OVER (PARTITION BY type_of_area
    ORDER BY substr(md5(CAST(row_id AS VARCHAR) || '#42'), 1, 13), row_id) AS place FROM labelled l) r
JOIN quota USING (type_of_area) WHERE place <= n_test"""
_SPLIT_CTES = {
    "labelled": "SELECT * FROM cleaned WHERE type_of_area <> 'unknown'",
    "sizes": "SELECT type_of_area, count(*) AS m, (SELECT count(*) FROM labelled) AS n FROM labelled GROUP BY 1",
    "shares": """SELECT *, n - CAST(ceil(n * 0.15) AS BIGINT) AS n_train,
      ((n - CAST(ceil(n * 0.15) AS BIGINT)) * m) // n AS whole, ((n - CAST(ceil(n * 0.15) AS BIGINT)) * m) % n AS part FROM sizes""",
    "quota": """SELECT type_of_area, m - whole - CASE WHEN row_number() OVER (ORDER BY part DESC, type_of_area)
      <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS n_test FROM shares""",
    "test_part": _TEST_SQL,
}


def _parts(spark, d):
    full = clean(spark, d)
    labelled, unlabelled = R.split_labelled(full)
    train, test = SP.stratified_split(labelled)
    return full, R.union_all(train, unlabelled), test


_DISTRIBUTION = over_clean("""
SELECT c.pos, c.category, f.n AS "full", t.n AS train, s.n AS test
FROM (VALUES (0, 'unknown'), (1, 'urban'), (2, 'suburban'), (3, 'rural')) c(pos, category)
LEFT JOIN (SELECT type_of_area, count(*) AS n FROM cleaned GROUP BY 1) f ON f.type_of_area = c.category
LEFT JOIN (SELECT type_of_area, count(*) AS n FROM cleaned WHERE row_id NOT IN (SELECT row_id FROM test_part) GROUP BY 1) t
  ON t.type_of_area = c.category
LEFT JOIN (SELECT type_of_area, count(*) AS n FROM test_part GROUP BY 1) s ON s.type_of_area = c.category""", **_SPLIT_CTES)


@query("a3_split_distribution", _DISTRIBUTION)
def a3(spark, d):
    return A.split_distribution(*_parts(spark, d))


_Q = "quantile_cont({c}, {p})"


def _fence(c: str, table: str) -> str:
    q1, q3 = _Q.format(c=c, p=0.25), _Q.format(c=c, p=0.75)
    return (f"SELECT '{c}' AS name, round({q1} - 1.5 * ({q3} - {q1}), 6) AS lo, round({q3} + 1.5 * ({q3} - {q1}), 6) AS hi "
            f"FROM {table}")


@query("a4_iqr_fences", " UNION ALL ".join(_fence(c, "lineitem") for c in LINE))
def a4(spark, d):
    bounds = L.iqr_bounds(X.table(spark, d, "lineitem"), LINE)
    return rounded(constants(spark, ["name", "lo", "hi"], [(c, *b) for c, b in bounds.items()], ["string", "double", "double"]))


@query("a5_sample_skewness", " UNION ALL ".join(
    f"SELECT '{c}' AS name, round(abs(skewness({c})), 5) AS skew, abs(skewness({c})) > 1 AS selected FROM {t}"
    for c, t in [("l_extendedprice", "lineitem"), ("o_totalprice", "orders"), ("p_retailprice", "part")]))
def a5(spark, d):
    rows = []
    for t, c in [("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("part", "p_retailprice")]:
        g = abs(A.sample_skewness(X.table(spark, d, t), [c])[c])
        rows.append((c, round(g, 5), g > 1))
    return constants(spark, ["name", "skew", "selected"], rows, ["string", "double", "boolean"])


def _corr_sql(cols, table):
    parts = []
    for j in range(len(cols)):
        for i in range(j):
            parts.append(f"SELECT '{cols[j]}' AS \"row\", '{cols[i]}' AS \"column\", round(corr({cols[j]}, {cols[i]}), 6) AS r FROM {table}")
    return " UNION ALL ".join(parts)


@query("a6_correlation", over_clean(_corr_sql(NUMERIC_HERE, "cleaned")))
def a6(spark, d):
    return rounded(A.correlations(clean(spark, d), NUMERIC_HERE))


def _hist_sql(c, t, bins=10):
    return f"""
WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
h AS (SELECT CAST(least(floor(({c} - lo) * {bins}.0 / (hi - lo)), {bins - 1}) AS INT) AS bin, count(*) AS n
      FROM {t}, r WHERE {c} IS NOT NULL GROUP BY 1)
SELECT CAST(b.range AS INT) AS bin, round(lo + b.range * ((hi - lo) / {bins}), 6) AS "left",
  round(lo + (b.range + 1) * ((hi - lo) / {bins}), 6) AS "right", coalesce(n, 0) AS n
FROM range({bins}) b CROSS JOIN r LEFT JOIN h ON h.bin = b.range"""


@query("a7_histogram", _hist_sql("o_totalprice", "orders"))
def a7(spark, d):
    return rounded(A.histogram(X.table(spark, d, "orders"), "o_totalprice"))


_KDE_SQL = """
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n,
  stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h FROM orders),
g AS (SELECT CAST(range AS INT) AS point, lo + range * ((hi - lo) / 199) AS x, lo, hi, h FROM range(200), r)
SELECT point, round(any_value(x), 4) AS x,
  round(sum(exp(-0.5 * pow((o_totalprice - x) / h, 2))) * ((any_value(hi) - any_value(lo)) / 10) / (any_value(h) * sqrt(2 * pi())), 4) AS density
FROM orders, g GROUP BY point"""


@query("a8_kde_curve", _KDE_SQL)
def a8(spark, d):
    return rounded(A.kde_curve(X.table(spark, d, "orders"), "o_totalprice"), 4)


def _box_sql(c, table, label="column", name=None, where="TRUE"):
    name = name or c
    q = {p: _Q.format(c=c, p=p) for p in (0.25, 0.5, 0.75)}
    return f"""
SELECT '{name}' AS "{label}", round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min({c}) FILTER (WHERE {c} >= lo AND {c} <= hi), 6) AS whisker_lo,
  round(max({c}) FILTER (WHERE {c} >= lo AND {c} <= hi), 6) AS whisker_hi,
  count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers, count({c}) AS n
FROM {table}, (SELECT {q[0.25]} AS q1, {q[0.5]} AS med, {q[0.75]} AS q3,
  {q[0.25]} - 1.5 * ({q[0.75]} - {q[0.25]}) AS lo, {q[0.75]} + 1.5 * ({q[0.75]} - {q[0.25]}) AS hi
  FROM {table} WHERE {where}) b WHERE {where}"""


@query("a9_box_statistics", " UNION ALL ".join(_box_sql(c, "lineitem") for c in LINE))
def a9(spark, d):
    return rounded(A.box_table(X.table(spark, d, "lineitem"), {c: F.col(c) for c in LINE}))


@query("a10_category_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus")))
def a10(spark, d):
    return A.category_counts(X.table(spark, d, "lineitem"))


@query("a11_target_counts", with_blocks("SELECT type_of_area, count(*) AS n FROM stations_raw GROUP BY 1"))
def a11(spark, d):
    return A.target_counts(X.stations_raw(spark, d))


_SPECIES_VOTES = """
SELECT c.row_id, v.pred_lgbm, no2 FROM cleaned c JOIN no2 ON c.lat = no2.lat AND c.lon = no2.lon
JOIN model_votes v ON v.row_id = c.row_id"""


@query("a12_species_by_prediction", over_clean(
    " UNION ALL ".join(_box_sql("no2", "sv", "pred_lgbm", c, f"pred_lgbm = '{c}'") for c in reversed(S.CLASSES)),
    "species_no2", "model_votes", no2=_SPECIES["no2"], sv=_SPECIES_VOTES))
def a12(spark, d):
    joined = R.join_on_keys(clean(spark, d), species(spark, d)[0])
    voted = joined.join(X.model_votes(spark, d).select(S.ROW_ID, "pred_lgbm"), S.ROW_ID)
    return rounded(A.box_by_class(voted, "no2", "pred_lgbm"))


@query("a13_axis_extent", """
SELECT round(min(o_totalprice) - 0.1 * (max(o_totalprice) - min(o_totalprice)), 6) AS o_totalprice_lo,
  round(max(o_totalprice) + 0.1 * (max(o_totalprice) - min(o_totalprice)), 6) AS o_totalprice_hi,
  round(min(o_custkey) - 0.1 * (max(o_custkey) - min(o_custkey)), 6) AS o_custkey_lo,
  round(max(o_custkey) + 0.1 * (max(o_custkey) - min(o_custkey)), 6) AS o_custkey_hi FROM orders""")
def a13(spark, d):
    df = X.table(spark, d, "orders").select("o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return rounded(A.axis_extent(df, "o_totalprice", "o_custkey"))


# -- R: splits and samples ----------------------------------------------------------------


@query("r1_stratified_split", over_clean("SELECT row_id, type_of_area FROM test_part", **_SPLIT_CTES))
def r1(spark, d):
    labelled = R.split_labelled(clean(spark, d))[0]
    return SP.stratified_split(labelled)[1].select(S.ROW_ID, S.TARGET)


_R2 = dict(_SPLIT_CTES)
_R2["hand"] = "SELECT DISTINCT lat, lon FROM hand_labels"
_R2["labelled"] = """SELECT * FROM cleaned c WHERE type_of_area <> 'unknown'
  AND NOT EXISTS (SELECT 1 FROM hand h WHERE h.lat = c.lat AND h.lon = c.lon)"""
_R2 = {"hand": _R2.pop("hand"), **_R2}


@query("r2_training_split", over_clean("""
SELECT row_id, 'test' AS part FROM test_part
UNION ALL SELECT row_id, 'hand' FROM cleaned c WHERE type_of_area <> 'unknown'
  AND EXISTS (SELECT 1 FROM hand h WHERE h.lat = c.lat AND h.lon = c.lon)
UNION ALL SELECT row_id, 'train' FROM labelled WHERE row_id NOT IN (SELECT row_id FROM test_part)
UNION ALL SELECT row_id, 'train' FROM cleaned WHERE type_of_area = 'unknown'""", "hand_labels", **_R2))
def r2(spark, d):
    train, test, hand = SP.split_for_training(clean(spark, d), hand_labels=X.hand_labels(spark, d))
    tag = lambda df, name: df.select(S.ROW_ID, F.lit(name).alias("part"))
    return R.union_all(tag(train, "train"), tag(test, "test"), tag(hand, "hand"))


_JOINED = "SELECT c.row_id, type_of_area FROM cleaned c JOIN no2 ON c.lat = no2.lat AND c.lon = no2.lon"


@query("r3_balanced_sample", over_clean("""
SELECT row_id, type_of_area FROM (
  SELECT *, row_number() OVER (PARTITION BY type_of_area
    ORDER BY substr(md5(CAST(row_id AS VARCHAR) || '#42'), 1, 13), row_id) AS place FROM joined) r
CROSS JOIN (SELECT least(count(*) FILTER (WHERE type_of_area = 'rural'), 100) AS q_rural,
  least(count(*) FILTER (WHERE type_of_area = 'suburban'), 100) AS q_suburban FROM joined) q
WHERE place <= CASE type_of_area WHEN 'rural' THEN q_rural WHEN 'suburban' THEN q_suburban
  WHEN 'urban' THEN 300 - q_rural - q_suburban ELSE 0 END""", "species_no2", no2=_SPECIES["no2"], joined=_JOINED))
def r3(spark, d):
    picked = SP.species_sample(clean(spark, d), species(spark, d)[0], known_only=True, n_sample=300)
    return picked.select(S.ROW_ID, S.TARGET)


@query("r5_class_weights", with_blocks("""
SELECT type_of_area, round((SELECT count(*) FROM stations_raw) / (4.0 * count(*)), 6) AS weight
FROM stations_raw GROUP BY 1"""))
def r5(spark, d):
    weights = SP.balanced_weights(X.stations_raw(spark, d))
    return constants(spark, [S.TARGET, "weight"], [(c, round(w, 6)) for c, w in weights.items()], ["string", "double"])


# -- L: learned columns -------------------------------------------------------------------


@query("l1_mean_imputation", over_clean(
    "SELECT row_id, " + ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM structural)), 4) AS {c}" for c in NUMERIC_HERE)
    + " FROM structural", upto="structural"))
def l1(spark, d):
    df = P.structural(X.stations_raw(spark, d))
    return rounded(I.fill(df, I.column_means(df, NUMERIC_HERE)).select(S.ROW_ID, *NUMERIC_HERE), 4)


def _mode_sql(c):
    return f"(SELECT {c} FROM structural WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("l2_mode_imputation", over_clean(
    "SELECT row_id, " + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in CODED_HERE) + " FROM structural",
    upto="structural"))
def l2(spark, d):
    df = P.structural(X.stations_raw(spark, d))
    return I.fill(df, I.column_modes(df, CODED_HERE)).select(S.ROW_ID, *CODED_HERE)


@query("l6_no_imputation", over_clean(
    f"SELECT row_id, altitude, {S.ROAD}, climatic_zone_year2016 FROM cleaned"))
def l6(spark, d):
    model = P.StationCleaner(impute=False).fit(X.stations_raw(spark, d))
    return model.transform(X.stations_raw(spark, d)).select(S.ROW_ID, "altitude", S.ROAD, "climatic_zone_year2016")


def _cap_sql(c):
    q1, q3 = _Q.format(c=c, p=0.25), _Q.format(c=c, p=0.75)
    return (f"(SELECT {q1} - 1.5 * ({q3} - {q1}) FROM orders)", f"(SELECT {q3} + 1.5 * ({q3} - {q1}) FROM orders)")


_LO, _HI = _cap_sql("o_totalprice")


@query("l7_iqr_capping", f"""
SELECT o_orderkey, round(CASE WHEN o_totalprice < {_LO} THEN {_LO} WHEN o_totalprice > {_HI} THEN {_HI}
  ELSE o_totalprice END, 6) AS o_totalprice FROM orders""")
def l7(spark, d):
    df = X.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(L.cap(df, L.iqr_bounds(df, ["o_totalprice"])))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("l8_one_hot", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"c_mktsegment_{s}\"" for s in _SEGMENTS[1:])
    + " FROM customer")
def l8(spark, d):
    df = X.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return L.one_hot(df, L.sorted_levels(df, ["c_mktsegment"]))


@query("l9_label_codes", """
SELECT p_partkey, CAST(code AS INT) AS p_type FROM part JOIN
 (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part) t) c USING (p_type)""")
def l9(spark, d):
    df = X.table(spark, d, "part").select("p_partkey", "p_type")
    return L.label_codes(df, L.sorted_levels(df, ["p_type"]))


def _scaled(kind, digits=6):
    def run(spark, d):
        df = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        cols = ["l_quantity", "l_extendedprice"]
        return rounded(L.apply_scale(df, L.scale_state(df, kind, cols)), digits)
    return run


def _scale_sql(shift, scale, digits=6):
    cols = ", ".join(
        f"round(({c} - {shift.format(c=c)}) / {scale.format(c=c)}, {digits}) AS {c}" for c in LINE[:2])
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem"


def _sub(expr):
    return f"(SELECT {expr} FROM lineitem)"


query("l12_standard_scaling", _scale_sql(_sub("avg({c})"), _sub("stddev_pop({c})"), 5))(_scaled("standard", 5))
query("l13_minmax_scaling", _scale_sql(_sub("min({c})"), _sub("max({c}) - min({c})")))(_scaled("minmax"))
query("l14_robust_scaling", _scale_sql(
    _sub("median({c})"), _sub("quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")))(_scaled("robust"))


@query("l18_full_one_hot", "SELECT p_partkey, " + ", ".join(
    f"CASE WHEN p_type = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"p_type_{s}\""
    for s in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) + " FROM part")
def l18(spark, d):
    df = X.table(spark, d, "part").select("p_partkey", "p_type")
    return L.one_hot(df, L.sorted_levels(df, ["p_type"]), drop_first=False)


@query("l11_power_transform")
def l11(spark, d):
    df = X.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return L.apply_power(df, L.power_state(df, ["o_totalprice"]))


_LAMBDA_SQL = f"""
WITH x AS (SELECT o_totalprice / 1000 AS x FROM orders),
g AS (SELECT (range - 50) / 10.0 AS lam FROM range(101)),
y AS (SELECT lam, x, CASE WHEN x >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END
    ELSE CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END AS y FROM x, g)
SELECT CAST(lam AS DOUBLE) AS lam FROM y GROUP BY lam
ORDER BY -count(*) / 2.0 * ln(var_pop(y)) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) DESC LIMIT 1"""


@query("l11_power_lambda", _LAMBDA_SQL)
def l11c(spark, d):
    df = X.table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("x"))
    return constants(spark, ["lam"], [(round(L.yeo_johnson_lambdas(df, ["x"])["x"], 1),)], ["double"])


@query("l11_power_constants")
def l11b(spark, d):
    state = L.power_state(X.table(spark, d, "lineitem"), LINE[:2])
    return constants(spark, ["name", "lambda", "mean", "scale"], [(c, *v) for c, v in state.items()],
                     ["string", "double", "double", "double"])


@query("l3_chained_ridge")
def l3(spark, d):
    df = P.structural(X.stations_raw(spark, d))
    return I.fit_linear_chain(df, NUMERIC_HERE).apply(df).select(S.ROW_ID, *NUMERIC_HERE)


# Observed values stay, and no gap is left.
_KEPT_VALUES = over_clean("SELECT row_id, 0 AS gaps, " + ", ".join(NUMERIC_HERE) + " FROM structural", upto="structural")


def _observed(filled, df):
    """Imputed values where there was one before, and the number of gaps left."""
    before = df.select(S.ROW_ID, *[F.col(c).isNull().alias(f"gap_{c}") for c in NUMERIC_HERE])
    gaps = sum((F.col(c).isNull().cast("int") for c in NUMERIC_HERE), F.lit(0))
    values = [F.when(~F.col(f"gap_{c}"), F.col(c)).alias(c) for c in NUMERIC_HERE]
    return filled.join(before, S.ROW_ID).select(S.ROW_ID, gaps.alias("gaps"), *values)


@query("l3_observed_values_kept", _KEPT_VALUES)
def l3b(spark, d):
    df = P.structural(X.stations_raw(spark, d))
    return _observed(I.fit_linear_chain(df, NUMERIC_HERE).apply(df), df)


@query("c3_cleaner_transform_default", f"{_KEPT_VALUES} WHERE {S.ROAD} >= 0")
def c3_default(spark, d):
    """The default cleaner; rows whose road distance was imputed are judged by the value it got and left out here."""
    df = P.structural(X.stations_raw(spark, d))
    model, out = P.StationCleaner().fit_transform(X.stations_raw(spark, d))
    return _observed(out, df).where(F.col(S.ROAD).isNotNull())


# One column with gaps and one predictor: its evidence rounds as a recursion over four sums.
_ONE_GAP = """
WITH RECURSIVE given AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x,
    CASE WHEN l_suppkey % 3 > 0 THEN l_extendedprice / 1000 END AS y FROM lineitem),
sums AS (
  SELECT count(*) AS n, avg(m.x) AS mx, avg(m.y) AS my, regr_sxx(m.y, m.x) AS gram, regr_sxy(m.y, m.x) AS moment,
    regr_syy(m.y, m.x) AS energy FROM given m WHERE y IS NOT NULL),
rounds AS (
  SELECT 0 AS r, CAST(NULL AS DOUBLE) AS old, 1 / (energy / n + 2.220446049250313e-16) AS noise, CAST(1 AS DOUBLE) AS weight,
    moment / (gram + energy / n + 2.220446049250313e-16) AS coef, false AS done FROM sums
  UNION ALL
  SELECT r + 1, coef, noise2, weight2, moment / (gram + weight2 / noise2),
    coalesce(abs(moment / (gram + weight2 / noise2) - coef) < 1e-3, false) OR r = 298
  FROM (
    SELECT *, (n - used + 2e-6) / (greatest(energy - 2 * coef * moment + coef * coef * gram, 0) + 2e-6) AS noise2
    FROM (SELECT *, (used + 2e-6) / (coef * coef + 2e-6) AS weight2
      FROM (SELECT *, noise * gram / (weight + noise * gram) AS used FROM rounds, sums) a) b) c
  WHERE NOT done),
-- the weights of the round that ended the search are those of one more update
last AS (SELECT * FROM rounds ORDER BY r DESC LIMIT 1),
ended AS (
  SELECT moment / (gram + w / ((n - used + 2e-6) / (greatest(energy - 2 * coef * moment + coef * coef * gram, 0) + 2e-6))) AS slope, mx, my
  FROM (SELECT *, (used + 2e-6) / (coef * coef + 2e-6) AS w
    FROM (SELECT *, noise * gram / (weight + noise * gram) AS used FROM last, sums) a) b)
SELECT l_orderkey, l_linenumber, x, round(coalesce(y, my + slope * (x - mx)), 6) AS y FROM given, ended"""


@query("l3_one_gap_column", _ONE_GAP)
def l3c(spark, d):
    y = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_extendedprice") / 1000)
    df = X.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), y.alias("y"))
    return I.fit_linear_chain(df, ["x", "y"]).apply(df).withColumn("y", F.round("y", 6))


# Twelve columns with gaps at random, so that most rows have a pattern of their own; observed values stay.
_MANY = [f"v{i}" for i in range(12)]
_MANY_SQL = f"""
SELECT l_orderkey, l_linenumber, 0 AS gaps, {", ".join(
    f"CASE WHEN (l_orderkey * 31 + l_linenumber * 17 + l_partkey * {2 * i + 3} + l_suppkey * {i + 1}) % 7 > 1 "
    f"THEN l_quantity * {i + 1} + l_discount * {100 - i} END AS {c}" for i, c in enumerate(_MANY))} FROM lineitem"""


@query("l3_pattern_per_row", _MANY_SQL)
def l3d(spark, d):
    def value(i):
        spot = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey") * (2 * i + 3) + F.col("l_suppkey") * (i + 1)
        return F.when(spot % 7 > 1, F.col("l_quantity") * (i + 1) + F.col("l_discount") * (100 - i)).cast("double")
    keys = ["l_orderkey", "l_linenumber"]
    df = X.table(spark, d, "lineitem").select(*keys, *[value(i).alias(c) for i, c in enumerate(_MANY)])
    filled = I.fit_linear_chain(df, _MANY, rounds=2).apply(df.select(*keys, *_MANY, *[F.col(c).alias(f"old_{c}") for c in _MANY]))
    gaps = sum((F.col(c).isNull().cast("int") for c in _MANY), F.lit(0))
    kept = [F.when(F.col(f"old_{c}").isNotNull(), F.col(c)).alias(c) for c in _MANY]
    return filled.select(*keys, gaps.alias("gaps"), *kept)


def _tree_chain(kind, **params):
    def run(spark, d):
        df = P.structural(X.stations_raw(spark, d))
        chain = I.fit_tree_chain(df, NUMERIC_HERE, kind, **params)
        return _observed(chain.apply(df), df)
    return run


query("l4_chained_forest", _KEPT_VALUES)(_tree_chain("rf"))
query("l5_chained_boosting_lgbm", _KEPT_VALUES)(_tree_chain("lgbm"))
query("l5_chained_boosting_cboost", _KEPT_VALUES)(_tree_chain("cboost"))


# -- E: metrics ---------------------------------------------------------------------------

VOTES = "model_votes"


@query("e1_accuracy", with_blocks("""
SELECT round(avg(CASE WHEN type_of_area = pred_lgbm THEN 1.0 ELSE 0 END), 9) AS accuracy,
 (SELECT round(avg(r), 9) FROM (SELECT avg(CASE WHEN type_of_area = pred_lgbm THEN 1.0 ELSE 0 END) AS r FROM model_votes GROUP BY type_of_area) q)
   AS balanced_accuracy FROM model_votes""", VOTES))
def e1(spark, d):
    table = M.contingency(X.model_votes(spark, d), S.TARGET, "pred_lgbm")
    return rounded(M.overall(M.per_label(table)).select("accuracy", "balanced_accuracy"), 9)


@query("e1_class_accuracy", with_blocks("""
SELECT type_of_area AS label, round(avg(CASE WHEN type_of_area = pred_rf THEN 1.0 ELSE 0 END), 9) AS accuracy,
  count(*) AS support FROM model_votes GROUP BY 1""", VOTES))
def e1b(spark, d):
    return rounded(M.class_accuracy(X.model_votes(spark, d), S.TARGET, "pred_rf"), 9)


_CM = "SELECT type_of_area AS y, " + ", ".join(
    f"count(*) FILTER (WHERE pred_xgb = '{c}') AS pred_{c}" for c in S.CLASSES) + " FROM model_votes GROUP BY 1"


@query("e2_confusion_matrix", with_blocks(_CM, VOTES))
def e2(spark, d):
    return M.confusion_matrix(X.model_votes(spark, d), S.TARGET, "pred_xgb")


REPORT = {
    "ct": "SELECT {by}CAST({y} AS VARCHAR) AS y, CAST({p} AS VARCHAR) AS p, count(*) AS n FROM {t} GROUP BY ALL",
    "spine": "SELECT {b}y AS label FROM ct UNION SELECT {b}p FROM ct",
    "per": """SELECT {b}label, coalesce(sum(n) FILTER (WHERE y = label), 0) AS support,
      coalesce(sum(n) FILTER (WHERE p = label), 0) AS predicted, coalesce(sum(n) FILTER (WHERE y = label AND p = label), 0) AS hits
      FROM spine JOIN ct {on} GROUP BY ALL""",
    "sc": """SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS prec,
      CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rec,
      CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f FROM per""",
}
REPORT_BODY = """
SELECT {b}label, round(prec, 4) AS "precision", round(rec, 4) AS recall, round(f, 4) AS f1, support FROM sc
UNION ALL SELECT {b}'accuracy', NULL, NULL, round(sum(hits) / sum(support), 4), sum(support) FROM sc {g}
UNION ALL SELECT {b}'macro avg', round(avg(prec), 4), round(avg(rec), 4), round(avg(f), 4), sum(support) FROM sc {g}
UNION ALL SELECT {b}'weighted avg', round(sum(prec * support) / sum(support), 4), round(sum(rec * support) / sum(support), 4),
  round(sum(f * support) / sum(support), 4), sum(support) FROM sc {g}"""


def report_parts(y, p, t, by=None):
    """Classification report as SQL: its body, and the named steps in front of it."""
    fill = {"by": f"{by}, " if by else "", "b": f"{by}, " if by else "", "on": f"USING ({by})" if by else "ON TRUE",
            "g": f"GROUP BY {by}" if by else "", "y": y, "p": p, "t": t}
    return REPORT_BODY.format(**fill), {k: v.format(**fill) for k, v in REPORT.items()}


def report_sql(y, p, t, *blocks, by=None):
    """Classification report as one SQL text."""
    body, steps = report_parts(y, p, t, by)
    return with_blocks(body, *blocks, **steps)


@query("e3_classification_report", report_sql("type_of_area", "pred_catboost", "model_votes", VOTES))
def e3(spark, d):
    return M.classification_report(X.model_votes(spark, d), S.TARGET, "pred_catboost")


@query("e3_report_two_classes", report_sql("quality", "toxic", "labels"))
def e3b(spark, d):
    df = X.table(spark, d, "labels").select(F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return M.classification_report(df, "quality", "toxic")


AGREE = """
WITH ct AS (SELECT {y} AS y, {p} AS p, CAST(count(*) AS DOUBLE) AS n FROM {t} GROUP BY 1, 2),
a AS (SELECT sum(n) AS m FROM ct GROUP BY y), b AS (SELECT sum(n) AS m FROM ct GROUP BY p),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS cells, (SELECT sum(m * (m - 1) / 2) FROM a) AS r,
  (SELECT sum(m * (m - 1) / 2) FROM b) AS c, (SELECT sum(n) FROM ct) AS size,
  (SELECT sum(n * ln(n)) FROM ct) AS lc, (SELECT sum(m * ln(m)) FROM a) AS lr, (SELECT sum(m * ln(m)) FROM b) AS lp)
SELECT round((cells - r * c / (size * (size - 1) / 2)) / ((r + c) / 2 - r * c / (size * (size - 1) / 2)), 9) AS ari,
  round(((ln(size) - lr / size) + (ln(size) - lp / size) - (ln(size) - lc / size))
    / (((ln(size) - lr / size) + (ln(size) - lp / size)) / 2), 9) AS nmi FROM s"""


@query("e4_ari_nmi", with_blocks("SELECT * FROM agreement", VOTES, agreement=AGREE.format(
    y="type_of_area", p="pred_xgb", t="model_votes")))
def e4(spark, d):
    return rounded(M.cluster_agreement(X.model_votes(spark, d), S.TARGET, "pred_xgb"), 9)


_GRID_VALUES = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in M.threshold_grid())
_GRID = {
    "grid": f"SELECT * FROM (VALUES {_GRID_VALUES}) g(threshold)",
    "base": f"SELECT type_of_area, {_TOP_SUB} AS top, greatest(p_rural, p_suburban, p_urban) AS pm FROM class_probs WHERE type_of_area <> 'unknown'",
    "ct": """SELECT threshold, type_of_area AS y, CASE WHEN pm >= threshold THEN top ELSE 'suburban' END AS p, count(*) AS n
      FROM base, grid GROUP BY 1, 2, 3""",
    "spine": "SELECT threshold, y AS label FROM ct UNION SELECT threshold, p FROM ct",
    "per": REPORT["per"].format(b="threshold, ", on="USING (threshold)"),
    "sc": REPORT["sc"],
    "scores": """SELECT threshold, round(avg(f), 9) AS f1_macro,
      round(avg(rec) FILTER (WHERE support > 0), 9) AS balanced_accuracy FROM sc GROUP BY threshold""",
}


def _labelled_probs(spark, d):
    return R.split_labelled(X.class_probs(spark, d))[0]


@query("e8_threshold_grid_f1", with_blocks("SELECT threshold, f1_macro AS score FROM scores", "class_probs", **_GRID))
def e8a(spark, d):
    return rounded(M.threshold_scores(_labelled_probs(spark, d), S.TARGET, probabilities(), "f1_macro"), 9, ("threshold",))


@query("e8_threshold_grid_balanced", with_blocks(
    "SELECT threshold, balanced_accuracy AS score FROM scores", "class_probs", **_GRID))
def e8b(spark, d):
    return rounded(M.threshold_scores(_labelled_probs(spark, d), S.TARGET, probabilities()), 9, ("threshold",))


@query("t4_best_threshold", with_blocks(
    "SELECT threshold, f1_macro AS score FROM scores ORDER BY f1_macro DESC, threshold LIMIT 1", "class_probs", **_GRID))
def t4(spark, d):
    scores = M.threshold_scores(_labelled_probs(spark, d), S.TARGET, probabilities(), "f1_macro")
    return rounded(M.best_threshold(scores), 9, ("threshold",))


@query("m12_threshold_prediction", with_blocks(f"""
SELECT row_id, CASE WHEN {_TOP_SUB.replace('p_suburban >= p_rural AND p_suburban >= p_urban', 'p_suburban > p_rural AND p_suburban >= p_urban')} = 'suburban'
  OR greatest(p_rural, p_suburban, p_urban) >= 0.5 THEN
  {_TOP_SUB.replace('p_suburban >= p_rural AND p_suburban >= p_urban', 'p_suburban > p_rural AND p_suburban >= p_urban')}
  ELSE 'suburban' END AS pred FROM class_probs""", "class_probs"))
def m12(spark, d):
    return X.class_probs(spark, d).select(S.ROW_ID, V.confident_class(probabilities()).alias("pred"))


@query("m13_majority_vote", with_blocks(
    f"SELECT type_of_area, voting, count(*) AS n FROM ({VOTE_SQL}) v JOIN model_votes USING (row_id) GROUP BY 1, 2", VOTES))
def m13(spark, d):
    voted = X.model_votes(spark, d).withColumn("voting", V.majority(F.array(*PREDS)))
    return voted.groupBy(S.TARGET, "voting").agg(F.count("*").alias("n"))


# -- S: sources and sinks -----------------------------------------------------------------

_STATION_COLUMNS = ["lat", "lon", "area_code", "timezone", "type_of_area", *NUMERIC_HERE, *CODED_HERE]


@query("s1_station_csv", with_blocks(f"SELECT {', '.join(_STATION_COLUMNS)} FROM stations_raw"))
def s1(spark, d):
    path = scratch_path(spark, "stations")
    sinks.write_csv(X.stations_raw(spark, d), f"{path}/stations.csv")
    return csv_files.load_stations(spark, "stations.csv", path).select(*_STATION_COLUMNS)


_FLAT = """SELECT row_id, CAST(json_extract_string(body, '$.coordinates.lat') AS DOUBLE) AS lat,
  CAST(json_extract_string(body, '$.coordinates.lng') AS DOUBLE) AS lon, json_extract_string(body, '$.codes[0]') AS area_code,
  json_extract_string(body, '$.timezone') AS timezone, json_extract_string(body, '$.type_of_area') AS type_of_area,
  CAST(json_extract_string(body, '$.coordinates.alt') AS DOUBLE) AS altitude,
  json_extract_string(body, '$.globalmeta.climatic_zone_year2016') AS climatic_zone_year2016,
  json_extract_string(body, '$.codes[1]') AS alias
FROM api_records WHERE json_extract(body, '$.coordinates') IS NOT NULL AND json_extract(body, '$.codes[0]') IS NOT NULL"""
_FLAT_COLUMNS = ["lat", "lon", "area_code", "timezone", "type_of_area", "altitude", "climatic_zone_year2016"]


def write_pages(spark, d, size=500):
    """Records as one JSON page per folder, written by Spark; gives the template, page size and page count."""
    path = scratch_path(spark, "pages")
    docs = X.api_records(spark, d).withColumn("offset", (F.floor(F.col(S.ROW_ID) / size) * size).cast("long"))
    in_order = F.array_sort(F.collect_list(F.struct(S.ROW_ID, "body")))  # a page has ``size`` records at most
    body = F.concat(F.lit("["), F.concat_ws(",", F.transform(in_order, lambda r: r["body"])), F.lit("]"))
    docs.groupBy("offset").agg(body.alias("value")).write.partitionBy("offset").text(path)
    return f"{path}/offset={{offset}}", size, docs.agg(F.max("offset")).first()[0] // size + 1


@query("s2_paged_source", with_blocks(f"SELECT {', '.join(_FLAT_COLUMNS)} FROM flat", "api_records", flat=_FLAT))
def s2(spark, d):
    return paged.first_stations(spark, *write_pages(spark, d)).select(*_FLAT_COLUMNS)


@query("s3_flatten_records", with_blocks(f"SELECT row_id, {', '.join(_FLAT_COLUMNS)} FROM flat", "api_records", flat=_FLAT))
def s3(spark, d):
    return records.flatten(X.api_records(spark, d)).select(S.ROW_ID, *_FLAT_COLUMNS)


@query("s4_malformed_records", with_blocks("""
SELECT row_id, body FROM api_records WHERE json_extract(body, '$.coordinates') IS NULL
  OR json_extract(body, '$.codes[0]') IS NULL""", "api_records"))
def s4(spark, d):
    return records.rejects(X.api_records(spark, d))


@query("s5_lookup_codes", with_blocks("""
SELECT pos, r.area_code AS requested_code, f.area_code, lat, lon FROM requested_codes r
JOIN flat f ON r.area_code = f.area_code OR r.area_code = f.alias""", "api_records", "requested_codes", flat=_FLAT))
def s5(spark, d):
    found = records.lookup_codes(X.api_records(spark, d), X.requested_codes(spark, d))
    return found.select("pos", "requested_code", "area_code", "lat", "lon")


@query("j7_missing_codes", with_blocks("""
SELECT pos, area_code FROM requested_codes r WHERE area_code NOT IN (SELECT area_code FROM flat)""",
       "api_records", "requested_codes", flat=_FLAT))
def j7(spark, d):
    codes = X.requested_codes(spark, d)
    found = records.lookup_codes(X.api_records(spark, d), codes)
    return records.missing_codes(codes, found).select("pos", "area_code")


@query("s6_station_coord", with_blocks(
    "SELECT lat, lon, altitude AS alt, type_of_area FROM flat WHERE area_code = 'ST0000042'", "api_records", flat=_FLAT))
def s6(spark, d):
    return records.station_coord(X.api_records(spark, d), "ST0000042")


_PAIRS = """SELECT CASE WHEN s_acctbal > 6000 THEN 'urban' WHEN s_acctbal > 3000 THEN 'suburban' ELSE 'rural' END AS area_type,
  r.area_code AS requested_code FROM requested_codes r JOIN supplier s ON s.s_suppkey = r.pos"""


@query("s7_hand_label_set", with_blocks("""
SELECT lat, lon, requested_code AS area_code, altitude, type_of_area AS type_of_area_source, area_type AS type_of_area_gmap
FROM pairs JOIN flat ON requested_code = area_code WHERE type_of_area <> 'unknown'""",
       "api_records", "requested_codes", flat=_FLAT, pairs=_PAIRS))
def s7(spark, d):
    supplier = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), "s_acctbal")
    bal = F.col("s_acctbal")
    kind = F.when(bal > 6000, "urban").when(bal > 3000, "suburban").otherwise("rural")
    pairs = X.requested_codes(spark, d).join(supplier, "pos").select(
        kind.alias("area_type"), F.col("area_code").alias("requested_code"))
    return records.hand_label_set(X.api_records(spark, d), pairs)


@query("s8_json_file", with_blocks("SELECT lat, lon, area_code, altitude FROM stations_raw"))
def s8(spark, d):
    path = scratch_path(spark, "json")
    docs = X.stations_raw(spark, d).withColumn("file", F.floor(F.col(S.ROW_ID) / 500)).groupBy("file").agg(
        F.to_json(F.collect_list(F.struct("lat", "lon", "area_code", "altitude"))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return inputs.json_rows(spark, path)


@query("s9_dataframe_input", with_blocks("SELECT row_id, area_code, altitude FROM stations_raw"))
def s9(spark, d):
    return inputs.normalise(spark, X.stations_raw(spark, d)).select(S.ROW_ID, "area_code", "altitude")


@query("s9_json_input", with_blocks("SELECT area_code, lat, lon, altitude FROM stations_raw"))
def s9b(spark, d):
    path = f"{scratch_path(spark, 'stations')}.json"
    docs = X.stations_raw(spark, d).withColumn("file", F.floor(F.col(S.ROW_ID) / 500)).groupBy("file").agg(
        F.to_json(F.collect_list(F.struct("lat", "lon", "area_code", "altitude"))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = inputs.normalise(spark, path)
    # every station has an id of its own
    once = rows.groupBy(S.ROW_ID).count().where("count > 1").select(S.ROW_ID)
    return rows.join(once, S.ROW_ID, "left_anti").select("area_code", "lat", "lon", "altitude")


@query("s10_species_files", with_blocks(
    "SELECT no2.lat, no2.lon, no2, nox FROM no2 JOIN nox ON no2.lat = nox.lat AND no2.lon = nox.lon",
    *SPECIES_BLOCKS, **_SPECIES))
def s10(spark, d):
    path = scratch_path(spark, "species")
    for n in ("no2", "nox"):
        sinks.write_csv(getattr(X, f"species_{n}")(spark, d), f"{path}/{n}/p75.csv")
    return csv_files.load_species(spark, path, "p75", ["no2", "nox"])


@query("s11_stamped_csv", with_blocks("SELECT area_code, altitude FROM stations_raw"))
def s11(spark, d):
    path = sinks.write_stamped(X.stations_raw(spark, d), scratch_path(spark, "stamped"))
    return csv_files.read_csv(spark, path, S.STATION_SCHEMA).select("area_code", "altitude")


@query("s12_prediction_export", with_blocks("SELECT area_code, type_of_area FROM stations_raw"))
def s12(spark, d):
    path = scratch_path(spark, "export")
    sinks.write_parquet(X.stations_raw(spark, d).select("area_code", S.TARGET), path, [S.TARGET])
    return spark.read.parquet(path).select("area_code", S.TARGET)


@query("s13_rows_as_json", with_blocks("""
SELECT json_object('row_id', row_id, 'area_code', area_code, 'type_of_area', type_of_area) AS record FROM stations_raw"""))
def s13(spark, d):
    return sinks.as_dicts(X.stations_raw(spark, d).select(S.ROW_ID, "area_code", S.TARGET))


# -- C: composites ------------------------------------------------------------------------


@query("c1_structural_cleaning", over_clean("SELECT * FROM structural", upto="structural"))
def c1(spark, d):
    return P.structural(X.stations_raw(spark, d))


@query("c3_cleaner_transform_mean", over_clean(
    "SELECT row_id, " + ", ".join(
        f"round(coalesce({c}, (SELECT avg({c}) FROM structural)), 4) AS {c}" for c in NUMERIC_HERE) + ", "
    + ", ".join(f"CAST(coalesce({c}, {_mode_sql(c)}) AS VARCHAR) AS {c}" for c in CODED_HERE)
    + f" FROM structural WHERE coalesce({S.ROAD}, (SELECT avg({S.ROAD}) FROM structural)) >= 0", upto="structural"))
def c3(spark, d):
    raw = X.stations_raw(spark, d)
    model = P.StationCleaner(imputer="mean").fit(raw)
    return rounded(model.transform(raw).select(S.ROW_ID, *NUMERIC_HERE, *CODED_HERE), 4)


@query("c4_cleaner_fit_transform", over_clean(
    f"SELECT row_id, type_of_area FROM structural WHERE coalesce({S.ROAD}, (SELECT avg({S.ROAD}) FROM structural)) >= 0",
    upto="structural"))
def c4(spark, d):
    return P.StationCleaner(imputer="mean").fit_transform(X.stations_raw(spark, d))[1].select(S.ROW_ID, S.TARGET)


@query("c5_cleaner_gate_all", over_clean(f"""
SELECT row_id, type_of_area FROM decoded WHERE ({GATE_HERE[0]} IS NOT NULL OR {GATE_HERE[1]} IS NOT NULL)
  AND {S.ROAD} >= 0""", upto="decoded"))
def c5(spark, d):
    raw = X.stations_raw(spark, d)
    return P.StationCleaner(gate_mode="all", impute=False).fit(raw).transform(raw).select(S.ROW_ID, S.TARGET)
