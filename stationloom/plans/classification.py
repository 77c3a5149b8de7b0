"""The supervised ensemble: training, prediction, probabilities, thresholds, storage."""

from __future__ import annotations

import logging
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions import voting as V
from stationloom.operators import rows as R
from stationloom.operators.oversampling import oversample
from stationloom.operators.sampling import balanced_weights, class_sizes, first_of_each, ids_and_labels
from stationloom.plans.members import HELD, MEMBERS, Member, filled, fit_member, translate
from stationloom.plans.state import read_json, write_json
from stationloom.plans.versions import committed, current, versions
from stationloom.session import shared_dir

log = logging.getLogger(__name__)

#: Rows of a boosting task, at least: below, a job per level costs more than it saves. Rows of a forest's task.
TASK_ROWS, FOREST_ROWS = 200_000, 2_000


class StationClassifier:
    """Up to four tree ensembles with majority vote.

    Identifiers are never features. Every string feature is a category. ``unknown`` labels and
    rows without one are left out of training. Oversampling needs numeric features and is
    skipped, with a warning, when there are categories.
    """

    def __init__(self, models: list[str] | None = None, use_smote: bool = True, rf_params: dict | None = None,
                 catboost_params: dict | None = None, lgbm_params: dict | None = None, xgb_params: dict | None = None):
        self.names = [m.lower() for m in (models or MEMBERS)]
        self.use_smote = use_smote
        self.params = {"rf": rf_params or {}, "catboost": catboost_params or {}, "lgbm": lgbm_params or {},
                       "xgb": xgb_params or {}}
        self.members: dict[str, Member] = {}

    def _require_fit(self) -> None:
        if not self.members:
            raise RuntimeError("This classifier is not fitted yet. Call fit() before using this method.")

    def fit(self, df: DataFrame, features: list[str] | None = None, target: str = S.TARGET) -> StationClassifier:
        """Train all members on the same rows."""
        for name in self.names:
            if name not in MEMBERS:
                raise ValueError(f"Unknown model {name!r}. Choose from {MEMBERS}.")
        shared_dir(df.sparkSession)
        features = features or [c for c in S.feature_columns(df) if c != target]
        categorical = [c for c in S.string_columns(df) if c in features]
        numeric = [c for c in features if c not in categorical]
        rows = df.where(F.col(target).isNotNull() & (F.col(target) != S.UNLABELLED))
        rows = rows.select(*S.present(df, [S.ROW_ID]), target, *features)
        if self.use_smote and categorical:
            log.warning("oversampling skipped, categorical columns found: %s", categorical)
        translated = {n: translate(n, self.params[n]) for n in self.names}
        shares = {n: params.get("heldShare", 0) for n, (params, _) in translated.items()}
        if any(shares.values()) or (categorical and "catboost" in self.names):
            rows = R.with_stable_row_id(rows)
        for share in sorted(set(shares.values())):
            held = self._held_rows(rows, target, share) if share else F.lit(False)
            train = rows.where(~held)
            if self.use_smote and not categorical:
                train = oversample(R.with_stable_row_id(train).persist(StorageLevel.MEMORY_AND_DISK), numeric, target)
            kept = [*S.present(train, [S.ROW_ID]), target, *features]
            work = filled(train, numeric, categorical).select(*kept)
            if share:
                watched = filled(rows.where(held), numeric, categorical).select(*kept)
                work = work.withColumn(HELD, F.lit(False)).unionAll(watched.withColumn(HELD, F.lit(True)))
            work = work.persist(StorageLevel.MEMORY_AND_DISK)
            own = work.where(~F.col(HELD)) if share else work
            sizes = class_sizes(own, target)
            classes = sorted(sizes)
            # every level of boosting is a job over all partitions, so small ones are joined; a forest's levels are few and large
            rows_in_all = sum(sizes.values())
            weights = balanced_weights(own, target) if any(b for _, b in translated.values()) else None
            tasks = max(1, math.ceil(rows_in_all / TASK_ROWS))
            spread = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows_in_all / FOREST_ROWS))
            work, cached = work.coalesce(tasks), work
            for name, (params, balanced) in translated.items():
                if shares[name] == share:
                    self.members[name] = fit_member(
                        name, cached.repartition(spread) if name == "rf" and spread > 1 else work, numeric, categorical, classes, weights if balanced else None, params, target, tasks)
            cached.unpersist()
        self.members = {n: self.members[n] for n in self.names}
        return self

    @staticmethod
    def _held_rows(rows: DataFrame, target: str, share: float):
        """Condition for ``share`` of each class by hash of the row id, one row at least of classes with two."""
        with ids_and_labels(rows, target) as narrow:
            sizes = class_sizes(narrow, target)
            quotas = {c: min(n - 1, max(1, round(n * share))) for c, n in sizes.items()}
            return first_of_each(narrow, quotas, sizes, target)

    def _score(self, df: DataFrame, model: str | None) -> tuple[DataFrame, list[str]]:
        self._require_fit()
        names = list(self.members) if model is None else [model]
        for name in names:
            df = self.members[name].score(df)
        return df, names

    def predict(self, df: DataFrame, model: str | None = None) -> DataFrame:
        """The frame with ``pred_<member>``; for all members also ``pred_voting``."""
        scored, names = self._score(df, model)
        scored = scored.drop(*[f"proba_{n}" for n in names])
        if model is not None:
            return scored
        return scored.withColumn("pred_voting", V.majority(F.array(*[f"pred_{n}" for n in names])))

    def predict_proba(self, df: DataFrame, model: str | None = None) -> DataFrame:
        """The frame with class probabilities ``proba_<member>`` in alphabetical class order."""
        scored, names = self._score(df, model)
        return scored.drop(*[f"pred_{n}" for n in names])

    def threshold_predict(self, df: DataFrame, threshold: float = 0.5, model: str | None = None) -> DataFrame:
        """The frame with ``pred_<member>``, uncertain rural and urban rows set to suburban."""
        scored, names = self._score(df, model)
        scored = scored.withColumns({f"pred_{n}": V.confident_class(F.col(f"proba_{n}"), threshold) for n in names})
        return scored.drop(*[f"proba_{n}" for n in names])

    def feature_names(self, model: str) -> list[str]:
        """Columns a member was trained on."""
        self._require_fit()
        return self.members[model].features

    def feature_importance(self, df: DataFrame, model: str) -> DataFrame:
        """Features of a member by falling importance."""
        self._require_fit()
        frame = df.sparkSession.createDataFrame(self.members[model].importances(), "feature string, importance double")
        return frame.orderBy(F.desc("importance"), "feature")

    def save(self, folder: str, model: str | None = None) -> list[str]:
        """Store one or all members with what is needed to use them alone."""
        self._require_fit()
        paths = []
        for name in [model] if model else list(self.members):
            member, path = self.members[name], f"{folder}/{name}"
            committed(path, lambda p, member=member: write_json(f"{p}/meta", member.save(p)))
            paths.append(path)
        return paths

    @classmethod
    def load(cls, folder: str, models: list[str]) -> StationClassifier:
        """Read the newest whole version of stored members."""
        out = cls(models=models, use_smote=False)
        for name in out.names:
            path = current(f"{folder}/{name}")
            out.members[name] = Member.load(path, read_json(f"{path}/meta"))
        return out

    @classmethod
    def stored(cls, spark, folder: str) -> list[str]:
        """Members found in a folder."""
        return [m for m in MEMBERS if versions(f"{folder}/{m}")]
