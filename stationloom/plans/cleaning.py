"""Station cleaning: structural steps, learned imputation, quality filter."""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions import cleaning as C
from stationloom.operators import impute as I
from stationloom.operators import rows as R
from stationloom.operators.summaries import cleaning_audit
from stationloom.operators.transforms import replaced
from stationloom.plans.state import OptionsEstimator, StateModel
from stationloom.session import checkpointed, path_exists

log = logging.getLogger(__name__)


def decode(df: DataFrame) -> DataFrame:
    """Time zones to regions, coded text to numbers, land cover to its parent class."""
    exprs = {c: C.code_of(F.col(c).cast("string")) for c in S.present(df, S.CODED_CATEGORIES)}
    if "timezone" in df.columns:
        exprs["timezone"] = C.timezone_region(F.col("timezone"))
    if S.LANDCOVER in exprs:
        exprs[S.LANDCOVER] = C.landcover_parent(exprs[S.LANDCOVER])
    if R.MARK in df.columns:  # text that raises must not do so in a row that is out already
        exprs = {c: F.when(F.col(R.MARK), e) for c, e in exprs.items()}
    return replaced(df, exprs)


def before_gate(df: DataFrame, sentinels_first: bool = False) -> DataFrame:
    """First row per coordinate, decoded, missing-value codes removed.

    Land cover is grouped before the codes are removed, so its ``-999`` becomes ``-1000`` and
    stays; ``sentinels_first`` turns it into null instead.
    """
    first = R.keep_first(R.with_row_id(df))
    if sentinels_first and S.LANDCOVER in df.columns:
        code = C.code_of(F.col(S.LANDCOVER).cast("string"))
        code = F.when(F.col(R.MARK), code) if R.MARK in first.columns else code
        first = first.withColumn(S.LANDCOVER, F.when(~code.isin(S.SENTINELS), F.col(S.LANDCOVER)))
    return R.drop_sentinels(decode(first))


def structural(
    df: DataFrame, gate: list[str] = S.GATE, mode: str = "any", sentinels_first: bool = False
) -> DataFrame:
    """Cleaning that needs no learned state."""
    return R.cross_fill_altitude(R.gate_missing(before_gate(df, sentinels_first), gate, mode))


def finish(df: DataFrame) -> DataFrame:
    """Road-distance filter and text form of the categories."""
    return R.categories_to_text(R.road_in_range(df))


def audit(df: DataFrame, gate: list[str] = S.GATE, mode: str = "any") -> DataFrame:
    """Rows in and out of each dropping step when nothing is imputed."""
    raw = R.with_row_id(df)
    first = before_gate(raw)
    road = F.col(S.ROAD) >= 0 if S.ROAD in df.columns else None
    return cleaning_audit(raw, first, R.gate_condition(first, gate, mode), road)


class StationCleaner(OptionsEstimator):
    """Cleans raw station rows; learns how to fill missing values.

    ``imputer`` is ``None`` (chained Bayesian ridge), ``mean``, ``rf``, ``lgbm`` or ``cboost``.
    ``gate_mode`` is ``any`` or ``all``. ``impute=False`` leaves gaps as they are.
    ``refit_on_transform`` learns the chained imputation on each frame it is applied to. With ``show_duplicates``,
    fitting leaves all rows of repeated coordinates in ``duplicates``, a DataFrame.
    """

    duplicates: DataFrame | None = None

    defaults = {
        "gate": S.GATE, "gate_mode": "any", "imputer": None, "impute": True, "show_duplicates": False,
        "verbose": True, "sentinels_first": False, "refit_on_transform": False, "chain_rounds": 10,
        "tree_params": {},
    }

    def _structural(self, df: DataFrame) -> DataFrame:
        return structural(df, self.opt("gate"), self.opt("gate_mode"), self.opt("sentinels_first"))

    def _learn(self, clean: DataFrame) -> StationCleanerModel:
        state = {"numeric": S.present(clean, S.NUMERIC), "coded": S.present(clean, S.CODED_CATEGORIES)}
        trees = None
        if self.opt("impute"):
            state["modes"] = I.column_modes(clean, state["coded"])
            trees = _learn_numeric(self, clean, state)
        model = StationCleanerModel(self.getOrDefault(self.options), state)
        model.trees = trees
        return model

    def _report(self, df: DataFrame) -> None:
        if self.opt("show_duplicates"):
            self.duplicates = R.duplicate_rows(df)

    def _fit(self, df: DataFrame) -> StationCleanerModel:
        return self.fit_transform(df, keep=False)[0]

    def fit_transform(self, df: DataFrame, keep: bool = True) -> tuple[StationCleanerModel, DataFrame | None]:
        """Fit, and apply the result to the same structurally cleaned frame, which is written to the shared folder for it."""
        self._report(df)
        clean = self._structural(df)
        if keep:
            # what the caller does with the result doesn't clean the raw rows again
            clean = checkpointed(clean)
            model = self._learn(clean)
            return model, model.impute(clean)
        clean = clean.persist(StorageLevel.MEMORY_AND_DISK)
        model = self._learn(clean)
        clean.unpersist()
        return model, None


def _learn_numeric(source, clean: DataFrame, state: dict):
    """Put the numeric imputer into the state; a tree chain is returned instead."""
    kind, columns = source.opt("imputer"), state["numeric"]
    if kind == "mean":
        state["means"] = I.column_means(clean, columns)
    elif kind is None:
        state["chain"] = I.fit_linear_chain(clean, columns, source.opt("chain_rounds")).to_state()
    else:
        return I.fit_tree_chain(clean, columns, kind, source.opt("chain_rounds"), **source.opt("tree_params"))
    return None


class StationCleanerModel(StateModel):
    """Fitted cleaner."""

    trees: I.TreeChain | None = None

    def impute(self, clean: DataFrame) -> DataFrame:
        """Imputation, quality filter and text form for a structurally cleaned frame."""
        if not self.opt("impute"):
            return finish(clean)
        state, trees = self.learned, self.trees
        if self.opt("refit_on_transform") and self.opt("imputer") != "mean":
            trees = _learn_numeric(self, R.kept(clean), state)
        if "means" in state:
            filled = I.fill(clean, state["means"])
        elif "chain" in state:
            filled = I.LinearChain.from_state(state["chain"]).apply(clean)
        else:
            filled = trees.apply(clean)
        return finish(I.fill(filled, state["modes"]))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.impute(structural(df, self.opt("gate"), self.opt("gate_mode"), self.opt("sentinels_first")))

    def marked(self, df: DataFrame) -> DataFrame:
        """All rows, cleaned as far as they get; ``R.MARK`` tells those that ``transform`` keeps."""
        return self.transform(R.marked(R.with_stable_row_id(df)))

    def _put(self, path: str) -> None:
        super()._put(path)
        if self.trees is not None:
            from stationloom.plans.state import write_json
            if not self.trees.of_spark:
                write_json(f"{path}/chain/boosted", self.trees.stored(f"{path}/chain/forests"))
                return
            for i, (_, model) in enumerate(self.trees.steps):
                model.write().save(f"{path}/chain/{i}")
            write_json(f"{path}/chain/index", {
                "columns": self.trees.columns, "means": self.trees.means, "targets": [t for t, _ in self.trees.steps],
            })

    @classmethod
    def _get(cls, path: str) -> StationCleanerModel:
        from pyspark.ml.regression import RandomForestRegressionModel

        from stationloom.plans.state import read_json
        model = super()._get(path)
        if model.opt("impute") and model.opt("imputer") in I.TREE_ESTIMATORS:
            if not path_exists(SparkSession.active(), f"{path}/chain/index"):
                model.trees = I.TreeChain.restored(read_json(f"{path}/chain/boosted"), f"{path}/chain/forests")
                return model
            index = read_json(f"{path}/chain/index")
            steps = [(t, RandomForestRegressionModel.load(f"{path}/chain/{i}")) for i, t in enumerate(index["targets"])]
            model.trees = I.TreeChain(index["columns"], index["means"], steps)
        return model
