import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationloom import fixtures as X
from stationloom import schema as S
from stationloom.plans import scoring as SC
from stationloom.plans import versions as BV
from stationloom.plans.classification import StationClassifier
from stationloom.plans.cleaning import StationCleaner
from stationloom.plans.features import FeatureEngineer
from stationloom.plans.refresh import refresh
from stationloom.sources import csv_files, inputs, paged, records, sinks
from stationloom.sources.parameters import load_parameters


def test_csv_comments_and_missing_texts(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "# made by hand\nlat,lon,area_code,timezone,extra,note\n"
        "1.5,2,A1,\"Etc/#1\",7,x # trailing\n\n# whole line\n3.25,NA,B2,, 8.5 ,None\n-4,NaN,\"C,3\",N,nan,\"say # no\"\n")
    df = csv_files.load_stations(spark, "s.csv", str(tmp_path))
    assert dict(df.dtypes) == {"lat": "double", "lon": "double", "area_code": "string", "timezone": "string",
                               "extra": "double", "note": "string"}
    rows = {r["area_code"]: r for r in df.collect()}
    assert rows["A1"].asDict() == {"lat": 1.5, "lon": 2.0, "area_code": "A1", "timezone": "Etc/#1", "extra": 7.0, "note": "x"}
    assert rows["B2"]["lon"] is None and rows["B2"]["timezone"] is None and rows["B2"]["extra"] == 8.5
    assert rows["C,3"]["note"] == "say # no" and rows["C,3"]["extra"] is None
    with pytest.raises(FileNotFoundError):
        csv_files.load_stations(spark, "absent.csv", str(tmp_path))
    (tmp_path / "bad.csv").write_text("lat,lon\n1,north\n")
    with pytest.raises(Exception, match="not a number: north"):
        csv_files.load_stations(spark, "bad.csv", str(tmp_path)).collect()


def test_csv_sink_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, " Asia /Tokyo"), (2, None, "a,b")], "row_id bigint, lat double, timezone string")
    path = sinks.write_stamped(df, str(tmp_path))
    assert path.endswith(".csv") and spark.sql("SELECT date_format(current_date(), 'dd.MM.yyyy')").first()[0] in path
    got = {(r["lat"], r["timezone"]) for r in csv_files.read_csv(spark, path, S.STATION_SCHEMA).collect()}
    assert got == {(1.0, " Asia /Tokyo"), (None, "a,b")}


def test_species_files(spark, tmp_path):
    for name, body in {"no2": "1,1,5\n2,2,6\n2,2,7\n3,3,\n4,4,9", "nox": "1,1,50\n3,3,60\n4,4,70"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "p75.csv").write_text("# species\nlat,lon,value\n" + body + "\n")
    both = csv_files.load_species(spark, str(tmp_path), "p75", ["no2", "nox"])
    assert {(r["lat"], r["no2"], r["nox"]) for r in both.collect()} == {(1.0, 5.0, 50.0), (4.0, 9.0, 70.0)}
    assert csv_files.load_species(spark, str(tmp_path), species="nox").columns == ["lat", "lon", "nox"]


def record(code, **changes):
    base = {"coordinates": {"lat": 1.0, "lng": 2, "alt": None}, "codes": [code, f"{code}-alias"], "timezone": "CET",
            "type_of_area": "urban", "globalmeta": {"climatic_zone_year2016": "7 x", S.ROAD: 4}}
    return {k: v for k, v in {**base, **changes}.items() if v is not ...}


def bodies(spark, *rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "row_id bigint, body string")


def test_malformed_records(spark):
    rows = [record("A"), record("B", codes=[]), record("C", coordinates=...), record("D", globalmeta=None),
            record("E", timezone=None), record("F", globalmeta=...), record("G", coordinates={"lat": 1.0, "lng": 2.0})]
    df = bodies(spark, *rows).unionByName(spark.createDataFrame([(9, "{not json")], "row_id bigint, body string"))
    flat = {r["area_code"]: r for r in records.flatten(df).collect()}
    assert set(flat) == {"A", "E"} and flat["E"]["timezone"] is None
    assert flat["A"]["lon"] == 2.0 and flat["A"]["altitude"] is None and flat["A"][S.ROAD] == 4.0
    assert len(records.flatten(df).columns) == 31
    assert sorted(r["row_id"] for r in records.rejects(df).collect()) == [1, 2, 3, 5, 6, 9]


def test_lookup_by_code_and_alias(spark):
    df = bodies(spark, record("A"), record("B", coordinates=...), record("C", type_of_area="unknown"))
    codes = records.code_table(spark, ["C", "missing", "A-alias", "B"])
    found = records.lookup_codes(df, codes)
    assert [(r["requested_code"], r["area_code"]) for r in found.collect()] == [("C", "C"), ("A-alias", "A")]
    assert sorted(r["area_code"] for r in records.missing_codes(codes, found).collect()) == ["B", "missing"]
    assert records.station_coord(df, "A").first().asDict() == {"lat": 1.0, "lon": 2.0, "alt": None, "type_of_area": "urban"}
    with pytest.raises(Exception, match="missing"):
        records.station_coord(df, "B").collect()
    hand = records.hand_label_set(df, records.label_pairs(spark, {"rural": ["A", "C"], "urban": ["A", "nope"]}))
    assert sorted((r["area_code"], r["type_of_area_gmap"]) for r in hand.collect()) == [("A", "rural"), ("A", "urban")]


def test_paged_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page_{i * 2}.json").write_text(json.dumps([record(f"S{i}a"), record(f"S{i}b", codes=[])]))
    url = f"file:{tmp_path}/page_{{offset}}.json"
    raw = paged.read_pages(spark, url, 2, 3)
    assert raw.rdd.getNumPartitions() == 3 and raw.count() == 6
    assert [r["area_code"] for r in paged.first_stations(spark, url, 2, 3).orderBy("row_id").collect()] == ["S0a", "S1a", "S2a"]
    with pytest.raises(Exception, match="No such file|URLError|PATH_NOT_FOUND"):
        paged.first_stations(spark, url, 2, 4).collect()
    path, bad = refresh(spark, str(tmp_path / "out"), url, 2, 3)
    assert csv_files.read_csv(spark, path, S.STATION_SCHEMA).count() == 3 and bad.count() == 3


def test_stored_pages_are_one_scan(spark, tmp_path):
    root = tmp_path / "a+b c%41"
    for i in range(40):
        folder = root / f"size=2,offset={i * 2}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(json.dumps([record(f"S{i}a"), record(f"S{i}b")] if i % 2 else record(f"S{i}a")))
    url = f"{root}/size={{limit}},offset={{offset}}"
    raw = paged.read_pages(spark, url, 2, 40)
    found = {r["row_id"]: json.loads(r["body"])["codes"][0] for r in raw.collect()}
    assert found == {i * 2 + k: f"S{i}{'ab'[k]}" for i in range(40) for k in range(1 + i % 2)}
    assert raw._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert paged._offset_pattern("/x/*/p{offset}", 2) is None and paged._offset_pattern("/x/p{offset:04d}", 2) is None
    twice = paged._offset_pattern("/x/{offset}/p{offset}.json", 2)
    assert re.match(twice, "file:/x/6/p6.json").group(1) == "6" and not re.match(twice, "file:/x/6/p8.json")


def test_stations_by_code(spark, tmp_path):
    for c in ("A", "B"):
        (tmp_path / f"{c}.json").write_text(json.dumps(record(c)))
    url = f"file:{tmp_path}/{{code}}.json"
    got = paged.stations_by_code(spark, url, ["B", "nope", "A"])
    assert [(r["pos"], r["area_code"]) for r in got.collect()] == [(0, "B"), (2, "A")]
    dicts = paged.stations_by_code(spark, url, "A", output="dicts")
    assert len(dicts) == 1 and dicts[0]["area_code"] == "A" and len(dicts[0]) == 30
    with pytest.raises(ValueError):
        paged.stations_by_code(spark, url, "A", output="rows")


def test_input_shapes(spark, tmp_path):
    one = {"lat": 1, "lon": 2.5, "area_code": "A", "altitude": None, "extra": 3}
    assert inputs.normalise(spark, one).count() == 1
    two = inputs.normalise(spark, [one, {**one, "area_code": "B", "altitude": float("nan")}])
    assert [r["altitude"] for r in two.collect()] == [None, None] and dict(two.dtypes)["lat"] == "double"
    assert inputs.normalise(spark, pd.DataFrame([one, one])).count() == 2
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text(json.dumps([one, one]))
    (tmp_path / "text.json").write_text(json.dumps("no"))
    assert inputs.normalise(spark, str(tmp_path / "one.json")).first()["lon"] == 2.5
    assert inputs.normalise(spark, tmp_path / "two.json").count() == 2
    with pytest.raises(ValueError):
        inputs.normalise(spark, str(tmp_path / "text.json"))
    with pytest.raises(FileNotFoundError):
        inputs.normalise(spark, str(tmp_path / "absent.json"))
    with pytest.raises(TypeError):
        inputs.normalise(spark, 5)
    with pytest.raises(ValueError):
        inputs.normalise(spark, [])
    with pytest.raises(ValueError):
        inputs.normalise(spark, two.limit(0))
    with pytest.raises(ValueError):
        inputs.normalise(spark, "A1")


def test_parameter_file(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("rf_params:\n  n_estimators: 12\nxgb_params:\n  gamma: 0.2\n")
    got = load_parameters(spark, str(tmp_path / "p.yaml"))
    assert got["rf_params"] == {"n_estimators": 12} and got["lgbm_params"] == {}
    assert StationClassifier(**got).params["xgb"] == {"gamma": 0.2}


@pytest.fixture(scope="module")
def artifacts(spark, sf, tmp_path_factory):
    raw = X.stations_raw(spark, sf)
    cleaner, clean = StationCleaner(imputer="mean").fit_transform(raw)
    prep, df = FeatureEngineer(
        selected=["area_code", S.TARGET, "altitude", S.ROAD, "timezone"], scaling="standard").fit_transform(clean)
    small = {"n_estimators": 2, "max_depth": 3}
    clf = StationClassifier(["rf", "lgbm"], use_smote=False, rf_params=small, lgbm_params=small).fit(df)
    folder = str(tmp_path_factory.mktemp("artifacts"))
    SC.save_artifacts(folder, cleaner, prep, clf)
    return folder


def test_scoring_covers_every_input_row(spark, sf, artifacts):
    raw = X.stations_raw(spark, sf)
    scorer = SC.BatchScorer(spark, artifacts)
    out = scorer.predict(raw)
    assert out.columns == ["lat", "lon", "area_code", "type_of_area", "pred_rf", "pred_lgbm", "pred_voting"]
    assert out.count() == 150
    kept = {r["area_code"] for r in scorer.cleaner.transform(raw).collect()}
    lost = {r["area_code"] for r in out.where(F.col("pred_rf") == S.NOT_SCORED).collect()}
    assert lost == {r["area_code"] for r in raw.collect()} - kept and lost
    ordered = [r["pred_rf"] == S.NOT_SCORED for r in scorer.predict(raw, ordered=True).collect()]
    assert ordered == sorted(ordered)
    assert "rf" in repr(scorer)


def test_models_see_only_rows_that_survive(spark, sf, artifacts, monkeypatch):
    raw = X.stations_raw(spark, sf)
    scorer = SC.BatchScorer(spark, artifacts)
    seen, predict = [], scorer.classifier.predict
    monkeypatch.setattr(scorer.classifier, "predict", lambda df, model: seen.append(df) or predict(df, model))
    assert scorer.predict(raw).count() == 150
    survivors = {r["row_id"] for r in scorer.cleaner.transform(raw).collect()}
    assert len(survivors) < 150 and sorted(r["row_id"] for r in seen[0].collect()) == sorted(survivors)
    none = scorer.predict(raw.withColumn(S.ROAD, F.lit(-5.0)))
    assert {r["pred_voting"] for r in none.collect()} == {S.NOT_SCORED} and none.count() == 150


def test_scoring_input_without_row_id_and_without_label(spark, sf, artifacts):
    raw = X.stations_raw(spark, sf)
    scorer = SC.BatchScorer(spark, artifacts, best_model="rf")
    out = scorer.predict(raw.drop("row_id", S.TARGET).repartition(5))
    assert out.columns == ["lat", "lon", "area_code", "pred_rf"] and out.count() == 150
    as_json = scorer.predict([r.asDict() for r in raw.limit(3).collect()], output_format="dicts")
    assert set(json.loads(as_json.first()["record"])) == {"lat", "lon", "area_code", "type_of_area", "pred_rf"}


def test_scoring_by_code(spark, sf, artifacts):
    docs = X.api_records(spark, sf)
    table = X.stations_raw(spark, sf).drop("row_id", "lat", "lon", "timezone", S.TARGET, "altitude", "climatic_zone_year2016")

    def fetch(codes):
        found = records.lookup_codes(docs, records.code_table(spark, codes))
        return found.select("pos", "requested_code", *S.BASE_FIELDS, "climatic_zone_year2016").join(table, "area_code")

    scorer = SC.BatchScorer(spark, artifacts, best_model="voting", fetch=fetch)
    got = scorer.predict(["ST0000003", "nope", "ST0000007"], ordered=True).collect()
    assert {r["area_code"] for r in got} == {"ST0000003", "ST0000007"}


def test_a_save_that_dies_leaves_the_version_before(spark, sf, artifacts):
    raw = X.stations_raw(spark, sf)
    before = BV.current(artifacts)
    scorer = SC.BatchScorer(spark, artifacts)

    class Dying:
        def save(self, folder):
            raise OSError("lost")

    other, _ = StationCleaner(imputer="mean").fit_transform(raw.limit(30))
    with pytest.raises(OSError):
        SC.save_artifacts(artifacts, other, scorer.features, Dying())
    assert BV.current(artifacts) == before
    assert SC.BatchScorer(spark, artifacts).cleaner.learned == scorer.cleaner.learned
    SC.save_artifacts(artifacts, other, scorer.features, scorer.classifier)
    assert BV.current(artifacts) > before and len(BV.versions(artifacts)) == 2
    assert SC.BatchScorer(spark, artifacts).cleaner.learned == other.learned
    first = SC.BatchScorer(spark, artifacts, version=BV.versions(artifacts)[0])
    assert first.cleaner.learned == scorer.cleaner.learned
    with pytest.raises(FileNotFoundError):
        SC.BatchScorer(spark, artifacts, version="9")


def test_scorer_arguments(spark, artifacts, tmp_path):
    with pytest.raises(FileNotFoundError):
        SC.BatchScorer(spark, str(tmp_path))
    with pytest.raises(ValueError):
        SC.BatchScorer(spark, artifacts, best_model="xgb")
    with pytest.raises(ValueError):
        SC.BatchScorer(spark, artifacts, output_format="rows")
