"""End-to-end scoring with stored artefacts."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions import voting as V
from stationloom.operators import rows as R
from stationloom.plans.classification import StationClassifier
from stationloom.plans.cleaning import StationCleanerModel
from stationloom.plans.features import FeatureEngineerModel
from stationloom.plans.versions import committed, current
from stationloom.session import checkpointed
from stationloom.sources import inputs, sinks

log = logging.getLogger(__name__)

CLEANER, FEATURES, CLASSIFIERS = "processor", "feature_engineer", "classifiers"
FORMATS = ("dataframe", "dicts")


def output_columns(members: list[str], best: str | None = None) -> list[str]:
    """Prediction columns to return: one model's, or all members' and the vote."""
    names = [*members, "voting"] if best is None else [best]
    return [f"pred_{n}" for n in names]


def save_artifacts(
    folder: str, cleaner: StationCleanerModel, features: FeatureEngineerModel, classifier: StationClassifier
) -> None:
    """Store everything scoring needs as one new version of the folder."""
    def parts(path: str) -> None:
        cleaner.store(f"{path}/{CLEANER}")
        features.store(f"{path}/{FEATURES}")
        classifier.save(f"{path}/{CLASSIFIERS}")

    committed(folder, parts)


class BatchScorer:
    """Loads stored artefacts once and scores any number of tables.

    ``version`` names a saved version, else the newest whole one is taken. ``fetch`` resolves
    station codes, see ``sources.inputs.normalise``.
    """

    def __init__(self, spark: SparkSession, models_dir: str, best_model: str | None = None,
                 output_format: str = "dataframe", verbose: bool = True,
                 fetch: Callable[[list[str]], DataFrame] | None = None, version: str | None = None):
        if output_format not in FORMATS:
            raise ValueError(f"no output format named {output_format!r}; there are {', '.join(FORMATS)}")
        self.spark, self.models_dir, self.best_model = spark, models_dir, best_model
        self.output_format, self.verbose, self.fetch = output_format, verbose, fetch
        stored = current(models_dir, version)
        self.cleaner = StationCleanerModel.restore(f"{stored}/{CLEANER}")
        self.features = FeatureEngineerModel.restore(f"{stored}/{FEATURES}")
        members = StationClassifier.stored(spark, f"{stored}/{CLASSIFIERS}")
        if not members:
            raise FileNotFoundError(f"{stored} holds no trained member")
        if best_model is not None and best_model not in [*members, "voting"]:
            raise ValueError(f"{best_model!r} is neither 'voting' nor stored in {models_dir}, which has {', '.join(members)}")
        self.classifier = StationClassifier.load(f"{stored}/{CLASSIFIERS}", members)

    def __repr__(self) -> str:
        return (f"BatchScorer(models_dir={self.models_dir!r}, models={list(self.classifier.members)}, "
                f"best_model={self.best_model!r})")

    def preprocess(self, raw: DataFrame) -> DataFrame:
        """Cleaned and prepared features of the rows that survive, with their ``row_id``."""
        return self.features.transform(self.cleaner.transform(raw))

    def predict(self, data, output_format: str | None = None, ordered: bool = False):
        """Identifiers, label where known, and predictions for every input row.

        Rows that cleaning drops, later duplicates of a coordinate among them, are marked and carry a message instead.
        They pass by the models and are put beside the scored rows, so nothing is joined back. ``ordered`` puts them last, each part in input order. The format ``dicts``
        gives one JSON object per row, still as a DataFrame.
        """
        form = output_format or self.output_format
        if form not in FORMATS:
            raise ValueError(f"no output format named {form!r}; there are {', '.join(FORMATS)}")
        raw = inputs.normalise(self.spark, data, self.fetch)
        members = list(self.classifier.members)
        wanted = output_columns(members, self.best_model)
        model = self.best_model if self.best_model in members else None
        # written once, as both halves read it: models only see the rows that survive
        marked = checkpointed(self.cleaner.marked(raw))
        scored = self.classifier.predict(self.features.transform(R.kept(marked)), model)
        dropped = marked.where(~F.col(R.MARK)).withColumns({c: F.lit(None).cast("string") for c in wanted})
        result = R.fill_not_scored(R.handed_back(scored, wanted).unionByName(R.handed_back(dropped, wanted)), wanted)
        if ordered:
            result = result.orderBy(F.desc("survived"), S.ROW_ID)
        result = result.drop("survived", S.ROW_ID)
        return sinks.as_dicts(result) if form == "dicts" else result


def vote(df: DataFrame, members: list[str]) -> DataFrame:
    """The frame with the majority of the given members; one member is its own majority."""
    return df.withColumn("pred_voting", V.majority(F.array(*[f"pred_{m}" for m in members])))
