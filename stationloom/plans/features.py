"""Feature preparation: selection, capping, encoding, skew correction, scaling."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions import cleaning as C
from stationloom.operators import rows as R
from stationloom.operators import transforms as L
from stationloom.plans.state import OptionsEstimator, StateModel

ENCODERS = ("ohe", "le")


def tidy(df: DataFrame, convert: list[str]) -> DataFrame:
    """Converted columns as numbers, the other categories as tidy text."""
    exprs = {c: C.lenient_number(F.col(c)) for c in S.present(df, convert)}
    for c in S.present(df, S.CATEGORICAL):
        if c not in ("area_code", S.TARGET) and c not in exprs:
            exprs[c] = C.tidy_category(F.col(c))
    return L.replaced(df, exprs)


class FeatureEngineer(OptionsEstimator):
    """Learns capping bounds, encoders, power transforms and a scaler on training rows.

    The order is selection, conversion, tidy text, capping, encoding, Yeo-Johnson on columns
    with absolute skewness above 1, scaling. The scaler sees what the steps before it produce.
    ``max_levels`` refuses to encode columns with more distinct values.
    """

    defaults = {
        "selected": None, "scaling": None, "scale_only": "numeric", "scale_features": True,
        "encoder": None, "encode": None, "encode_categories": True, "convert": None,
        "cap_outliers": False, "handle_skewness": True, "verbose": True, "max_levels": None,
    }

    def _check(self) -> None:
        wants = self.opt("encode_categories") and self.opt("encode") and self.opt("encoder")
        if wants and self.opt("encoder") not in ENCODERS:
            raise ValueError(f"no encoder named {self.opt('encoder')!r}; there are {', '.join(ENCODERS)}")
        if self.opt("scale_features") and self.opt("scaling"):
            if self.opt("scaling") not in L.SCALERS:
                raise ValueError(f"scaling must be one of {list(L.SCALERS)}.")
            if self.opt("scale_only") not in ("numeric", "all"):
                raise ValueError("scale_only must be 'numeric' or 'all'.")

    def _fit(self, df: DataFrame) -> FeatureEngineerModel:
        self._check()
        chosen = R.keep_columns(df, _selection(df, self.opt("selected")))
        work = tidy(chosen, self.opt("convert") or []).persist(StorageLevel.MEMORY_AND_DISK)
        base = work
        numeric = S.numeric_columns(work, S.NUMERIC)
        state = {"bounds": {}, "levels": {}, "power": {}, "scale": {}}
        if self.opt("cap_outliers") and numeric:
            state["bounds"] = L.iqr_bounds(work, numeric)
            work = L.cap(work, state["bounds"])
        encode = S.present(work, self.opt("encode") or [])
        if self.opt("encode_categories") and encode and self.opt("encoder"):
            state["levels"] = L.sorted_levels(base, encode, self.opt("max_levels"))
            work = _encode(work, self.opt("encoder"), state["levels"])
        numeric = S.numeric_columns(work, S.NUMERIC)
        if self.opt("handle_skewness") and numeric:
            state["power"] = L.power_state(work, L.skewed_columns(work, numeric))
            work = L.apply_power(work, state["power"])
        if self.opt("scale_features") and self.opt("scaling"):
            everything = [c for c in S.numeric_columns(work) if c not in (S.ROW_ID, *S.KEYS)]
            columns = numeric if self.opt("scale_only") == "numeric" else everything
            state["scale"] = L.scale_state(work, self.opt("scaling"), columns)
        base.unpersist()
        state["columns"] = work.columns
        return FeatureEngineerModel(self.getOrDefault(self.options), state)

    def fit_transform(self, df: DataFrame) -> tuple[FeatureEngineerModel, DataFrame]:
        """Fit, and apply the result to the same frame."""
        model = self.fit(df)
        return model, model.transform(df)


def _selection(df: DataFrame, selected: list[str] | None) -> list[str] | None:
    """Selected columns together with the row identity and marks, which every stage carries."""
    if selected is None:
        return None
    carried = [c for c in S.present(df, [S.ROW_ID, *S.KEYS, R.GIVEN, R.MARK]) if c not in selected]
    return [*carried, *selected]


def _encode(df: DataFrame, encoder: str, levels: dict[str, list[str]]) -> DataFrame:
    return L.one_hot(df, levels) if encoder == "ohe" else L.label_codes(df, levels)


class FeatureEngineerModel(StateModel):
    """Fitted feature preparation: a pure projection."""

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.learned
        work = tidy(R.keep_columns(df, _selection(df, self.opt("selected"))), self.opt("convert") or [])
        work = L.cap(work, state["bounds"])
        if state["levels"]:
            work = _encode(work, self.opt("encoder"), state["levels"])
        work = L.apply_power(work, state["power"])
        return L.apply_scale(work, state["scale"])

    def feature_names(self) -> list[str]:
        """Columns of the transformed frame that are neither identity nor target."""
        return [c for c in self.learned["columns"] if c not in (S.ROW_ID, *S.ID_COLUMNS, S.TARGET)]
