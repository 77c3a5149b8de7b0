"""Hyper-parameter files with one block per ensemble member."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stationloom.session import path_exists

BLOCKS = ["rf_params", "catboost_params", "lgbm_params", "xgb_params"]


def load_parameters(spark: SparkSession, path: str) -> dict[str, dict]:
    """The member blocks of a YAML file, ready for ``StationClassifier(**blocks)``."""
    import yaml

    if not path_exists(spark, path):
        raise FileNotFoundError(f"Data file not found: {path}")
    text = spark.read.text(path, wholetext=True).first()["value"]
    content = yaml.safe_load(text) or {}
    return {name: content.get(name) or {} for name in BLOCKS}
