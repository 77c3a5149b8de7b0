"""Estimators whose learned state is one JSON parameter.

The ordinary Spark ML writer then saves and loads them, alone or inside a pipeline.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import SparkSession

from stationloom.plans.versions import committed, current
from stationloom.session import path_exists

__all__ = ["OptionsEstimator", "StateModel", "read_json", "write_json", "require_path"]


class _Options(Params):
    """Constructor options kept as one JSON parameter."""

    options = Param(Params._dummy(), "options", "constructor options as JSON", typeConverter=TypeConverters.toString)

    def opt(self, name: str):
        return json.loads(self.getOrDefault(self.options))[name]


class OptionsEstimator(Estimator, _Options, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator with a dictionary of options."""

    defaults: dict = {}

    def __init__(self, **given):
        super().__init__()
        unknown = set(given) - set(self.defaults)
        if unknown:
            raise TypeError(f"unknown options: {sorted(unknown)}")
        self._set(options=json.dumps({**self.defaults, **given}))

    def save(self, path: str) -> None:
        raise RuntimeError("Not fitted: call fit() and save the model it returns.")

    def transform(self, df):
        raise RuntimeError("Call fit() before transform().")


class StateModel(Model, _Options, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted state and the options it was fitted with."""

    state = Param(Params._dummy(), "state", "learned state as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, options: str | None = None, learned: dict | None = None):
        super().__init__()
        if options is not None:
            self._set(options=options, state=json.dumps(learned))

    @property
    def learned(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def store(self, path: str) -> None:
        """Write the model as a new version of the folder."""
        committed(path, self._put)

    def _put(self, path: str) -> None:
        self.write().save(f"{path}/model")

    @classmethod
    def restore(cls, path: str):
        """Read the newest whole version; where there is none, ``FileNotFoundError`` is raised."""
        return cls._get(current(path))

    @classmethod
    def _get(cls, path: str):
        return cls.load(f"{path}/model")


def require_path(path: str) -> None:
    spark = SparkSession.active()
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing stored at {path!r}")


def write_json(path: str, content: dict) -> None:
    """One JSON document as a text folder on the shared file system."""
    frame = SparkSession.active().createDataFrame([(json.dumps(content),)], "value string")
    frame.coalesce(1).write.mode("overwrite").text(path)


def read_json(path: str) -> dict:
    require_path(path)
    return json.loads(SparkSession.active().read.text(path).first()["value"])
