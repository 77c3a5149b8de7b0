"""Shape of the physical plans that matter at scale."""

from pyspark.sql import functions as F

from stationloom import fixtures as X
from stationloom.operators import rows as R
from stationloom.operators import sampling as SP
from stationloom.plans import cleaning as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_is_cut_before_the_shuffle(spark, sf):
    text = plan(R.keep_first(X.stations_raw(spark, sf)))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("lat"), F.lit(1.0).alias("lon"),
        F.lit("CET").alias("timezone"), F.lit(5.0).alias("altitude"), F.lit("urban").alias("type_of_area")).write.parquet(path)
    text = plan(P.structural(spark.read.parquet(path)).select("altitude"))
    assert "ReadSchema: struct<row_id:bigint,lat:double,lon:double,altitude:double>" in text
    labelled = plan(R.split_labelled(spark.read.parquet(path))[1].select("row_id"))
    assert "PushedFilters: [IsNotNull(type_of_area), EqualTo(type_of_area,unknown)]" in labelled or "EqualNullSafe(type_of_area,unknown)" in labelled


def test_duplicates_are_counted_map_side_without_a_window(spark, sf):
    text = plan(R.drop_all_duplicates(X.species_no2(spark, sf), "value"))
    assert "Window" not in text and "partial_count" in text


def test_a_split_is_a_filter(spark, sf):
    st = X.stations_raw(spark, sf).where("type_of_area <> 'unknown'")
    before = plan(st).count("Exchange")
    test = SP.stratified_split(st)[1]
    assert plan(test).count("Exchange") == before and "Window" not in plan(test)


def test_no_cartesian_products(spark, sf):
    import __spark_entry__ as entry
    for name in ("c1_structural_cleaning", "p14_not_scored_message", "j1_species_join", "s5_lookup_codes", "e8_threshold_grid_f1", "e4_ari_nmi"):
        text = plan(entry.queries()[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
