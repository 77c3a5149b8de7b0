"""The four ensemble members as tree models.

``rf`` is Spark's random forest on one-hot categories. The boosted members grow the trees of all
classes together (``operators/boosting.py``). They differ in how they see categories (``catboost`` by
shares of the classes among earlier rows, ``lgbm`` and ``xgb`` as nominal splits), in how trees grow
(symmetrically, best leaf first, by levels), in sampling and in regularisation.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom import schema as S
from stationloom.functions.cleaning import literal_map
from stationloom.operators import boosting
from stationloom.operators.encoding import CategoryCodes, TargetShares
from stationloom.plans.state import read_json, write_json

log = logging.getLogger(__name__)

MEMBERS = ["rf", "catboost", "lgbm", "xgb"]
BELOW_ANY_VALUE = -1.0e9  # stands in for a missing number, which trees then split off

# Default hyper-parameters of the members.
DEFAULTS = {
    "rf": {"n_estimators": 500, "random_state": 42},
    "catboost": {
        "iterations": 500, "learning_rate": 0.03986794927756705, "depth": 9, "l2_leaf_reg": 6,
        "random_strength": 3.4439060846939396, "min_data_in_leaf": 49, "bootstrap_type": "MVS", "verbose": False,
    },
    "lgbm": {"n_estimators": 500, "max_depth": 20, "verbose": 0},
    "xgb": {
        "n_estimators": 500, "eval_metric": "mlogloss", "random_state": 42, "verbosity": 0, "enable_categorical": True,
    },
}
# End of fixed values.

_ROUNDS = ("n_estimators", "iterations", "num_iterations", "num_boost_round")
_ALIASES = {
    "max_depth": "maxDepth", "depth": "maxDepth",
    "learning_rate": "stepSize", "eta": "stepSize",
    "subsample": "subsamplingRate",
    "max_features": "featureSubsetStrategy", "colsample_bytree": "featureSubsetStrategy",
    "min_samples_leaf": "minInstancesPerNode", "min_data_in_leaf": "minInstancesPerNode",
    "min_child_samples": "minInstancesPerNode",
    "random_state": "seed", "random_seed": "seed",
    "gamma": "summedGain", "min_split_gain": "summedGain",
    "reg_alpha": "l1", "alpha": "l1", "lambda_l1": "l1",
    "reg_lambda": "l2", "lambda": "l2", "lambda_l2": "l2", "l2_leaf_reg": "l2",
    "min_child_weight": "minWeight", "min_sum_hessian_in_leaf": "minWeight",
    "criterion": "impurity", "bootstrap": "bootstrap",
}
_SILENT = {
    "n_jobs", "verbose", "verbosity", "objective", "num_class", "loss_function", "eval_metric", "tree_method",
    "enable_categorical", "bootstrap_type",
}
_BOOSTED_ONLY = {"l1", "l2", "minWeight"}
_MAX_SPARK_DEPTH = 30
#: Marks the rows that are held back from boosting.
HELD = "__held"


def translate(name: str, given: dict) -> tuple[dict, bool]:
    """Spark parameters for merged hyper-parameters, and whether classes are to be balanced.

    Depths beyond Spark's 30 raise; an unlimited one (``None`` or -1) becomes 30. ``leaf_depth=True`` bounds
    the depth by ``num_leaves``, for members that grow by leaves elsewhere. ``early_stopping_rounds`` needs rows to
    look at, as in the libraries: it only acts with ``validation_fraction``, the share of each class that is held
    back. Boosting then ends at the round after which that many rounds don't lower the loss of those rows by more
    than ``validationTol`` (0 unless given).
    """
    merged = {**DEFAULTS[name], **given}
    if any(k in given for k in _ROUNDS):
        merged = {k: v for k, v in merged.items() if k not in _ROUNDS or k in given}
    out: dict = {}
    balanced = False
    for key, value in merged.items():
        if key in _ROUNDS:
            out["numTrees" if name == "rf" else "maxIter"] = int(value)
        elif key in ("class_weight", "auto_class_weights"):
            balanced = str(value).lower() == "balanced"
        elif name == "rf" and _ALIASES.get(key) in _BOOSTED_ONLY:
            log.warning("%s: parameter %r has no counterpart and is ignored", name, key)
        elif key in _ALIASES:
            spark_name = _ALIASES[key]
            if spark_name == "maxDepth":
                value = _MAX_SPARK_DEPTH if value is None or int(value) < 0 else int(value)
                if value > _MAX_SPARK_DEPTH:
                    raise ValueError(f"{name}: depth {value} is beyond {_MAX_SPARK_DEPTH}, the deepest tree of Spark")
            elif spark_name == "minInstancesPerNode":
                value = max(1, int(value))
            elif spark_name == "featureSubsetStrategy":
                value = str(value)
            out[spark_name] = value
        elif key in ("numTrees", "maxIter", "maxBins", "minInfoGain", "checkpointInterval", "validationTol"):
            out[key] = value
        elif key == "early_stopping_rounds":
            out["patience"] = int(value or 0)
        elif key == "validation_fraction":
            out["heldShare"] = float(value or 0)
        elif key in ("num_leaves", "leaf_depth"):
            continue
        elif key not in _SILENT:
            log.warning("%s: parameter %r has no counterpart and is ignored", name, key)
    stops = {k: out.pop(k, 0) for k in ("patience", "heldShare", "validationTol")}
    if name != "rf" and stops["patience"] > 0 and stops["heldShare"] > 0:
        out |= stops
    if name == "rf":
        out.setdefault("featureSubsetStrategy", "sqrt")
        out.setdefault("maxDepth", _MAX_SPARK_DEPTH)
        out.pop("stepSize", None)
    elif name == "lgbm":
        if merged.get("leaf_depth"):
            out["maxDepth"] = min(out.get("maxDepth", _MAX_SPARK_DEPTH), math.ceil(math.log2(merged.get("num_leaves", 31))))
        out["leaves"] = int(merged.get("num_leaves", 31))
        out.setdefault("minInstancesPerNode", 20)
        out.setdefault("minWeight", 1e-3)
        out.setdefault("seed", 7)
    elif name == "xgb":
        out.setdefault("maxDepth", 6)
        out.setdefault("stepSize", 0.3)
        out.setdefault("featureSubsetStrategy", "all")
        out.setdefault("l2", 1.0)
        out.setdefault("minWeight", 1.0)
    else:
        out.setdefault("seed", 42)
        out.setdefault("l2", 3.0)
    return out, balanced


def settings(name: str, params: dict, classes: int, features: int) -> boosting.Settings:
    """What a boosted member grows, from translated parameters.

    The libraries differ in the second derivatives of softmax and in whether a gain is halved before it is held
    against its bound; both are kept.
    """
    share = params.get("featureSubsetStrategy", "all")
    share = {"all": 1.0, "auto": 1.0, "sqrt": math.sqrt(features) / features, "onethird": 1 / 3}.get(share) or float(share)
    return boosting.Settings(
        outputs=classes, rounds=params.get("maxIter", 100), rate=params.get("stepSize", 0.1), depth=params.get("maxDepth", 6),
        leaves=params.get("leaves"), symmetric=name == "catboost", l1=float(params.get("l1", 0)), l2=float(params.get("l2", 0)),
        min_gain=float(params.get("summedGain", 0)) * (2 if name == "xgb" else 1), min_rows=params.get("minInstancesPerNode", 1),
        min_weight=float(params.get("minWeight", 0)), row_share=float(params.get("subsamplingRate", 1)), column_share=share,
        curvature={"xgb": 2.0, "lgbm": classes / max(1, classes - 1)}.get(name, 1.0), seed=int(params.get("seed", 42)))


class Member:
    """One fitted ensemble member."""

    def __init__(self, name: str, classes: list[str], numeric: list[str], categorical: list[str],
                 preparation: PipelineModel | CategoryCodes | TargetShares, model):
        self.name, self.classes, self.numeric, self.categorical = name, classes, numeric, categorical
        self.preparation, self.model = preparation, model

    @property
    def features(self) -> list[str]:
        """Input columns of the member."""
        return [*self.numeric, *self.categorical]

    def score(self, df: DataFrame) -> DataFrame:
        """The frame with class probabilities ``proba_<name>`` and the class ``pred_<name>``.

        Features the frame lacks count as 0.
        """
        kept = df.columns
        work = df.withColumns({c: F.lit("0") if c in self.categorical else F.lit(0.0)
                               for c in self.features if c not in kept})
        work = filled(work, self.numeric, self.categorical)
        proba = f"proba_{self.name}"
        if self.name == "rf":
            scored = self.model.transform(self.preparation.transform(work)).withColumn(proba, vector_to_array("probability"))
        else:
            # as large as the parameters say: rounds x classes x leaves
            shared = df.sparkSession.sparkContext.broadcast(self.model)

            @F.pandas_udf("array<double>")
            def probabilities(x: pd.Series) -> pd.Series:
                if not len(x):
                    return pd.Series([], dtype=object)
                return pd.Series(list(shared.value.probabilities(np.stack(x.to_list()))))

            scored = work.withColumn(proba, probabilities(_numbers(self.numeric, self.preparation)))
        names = F.array(*[F.lit(c) for c in self.classes])
        probs = F.col(f"proba_{self.name}")
        top = F.array_position(probs, F.array_max(probs)).cast("int")
        shadow = {c: F.col(f"__keep_{c}") for c in self.features if f"__keep_{c}" in scored.columns}
        scored = scored.withColumn(f"pred_{self.name}", F.element_at(names, top)).withColumns(shadow)
        return scored.select(*kept, f"proba_{self.name}", f"pred_{self.name}")

    def importances(self) -> list[tuple[str, float]]:
        """Importance per input column of the model."""
        if self.name == "rf":
            names, values = vector_names(self.preparation, self.numeric, self.categorical), self.model.featureImportances.toArray()
        else:
            each = len(self.classes) if self.name == "catboost" else 1
            names, values = [*self.numeric, *[c for c in self.categorical for _ in range(each)]], self.model.importances()
        totals: dict[str, float] = {}
        for name, value in zip(names, values, strict=True):
            totals[name] = totals.get(name, 0.0) + float(value)
        return sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))

    def save(self, path: str) -> dict:
        """Store the model; gives back what is needed to read it again."""
        if self.name == "rf":
            self.preparation.write().overwrite().save(f"{path}/preparation")
            self.model.write().overwrite().save(f"{path}/model")
        else:
            write_json(f"{path}/boosted", {"model": self.model.to_state(), "preparation": self.preparation.to_state()})
        return {"name": self.name, "classes": self.classes, "numeric": self.numeric, "categorical": self.categorical}

    @classmethod
    def load(cls, path: str, meta: dict) -> Member:
        """Read a stored member."""
        parts = [meta[k] for k in ("name", "classes", "numeric", "categorical")]
        if meta["name"] == "rf":
            return cls(*parts, PipelineModel.load(f"{path}/preparation"), RandomForestClassificationModel.load(f"{path}/model"))
        state = read_json(f"{path}/boosted")
        encoding = (TargetShares if meta["name"] == "catboost" else CategoryCodes)(**state["preparation"])
        return cls(*parts, encoding, boosting.Boosted.from_state(state["model"]))


def _numbers(numeric: list[str], encoding: CategoryCodes | TargetShares):
    """The features of a boosted member as one array."""
    return F.array(*[F.col(c) for c in numeric], *encoding.expressions()).cast("array<double>")


def filled(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Numbers without nulls and categories as text, originals kept beside them."""
    keep = {f"__keep_{c}": F.col(c) for c in [*numeric, *categorical]}
    exprs = {c: F.coalesce(F.col(c).cast("double"), F.lit(BELOW_ANY_VALUE)) for c in numeric}
    exprs |= {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in categorical}
    return df.withColumns(keep).withColumns(exprs)


def vector_names(prep: PipelineModel, numeric: list[str], categorical: list[str]) -> list[str]:
    """Names of the vector entries a preparation produces."""
    encoders = [s for s in prep.stages if hasattr(s, "categorySizes")]
    if not encoders:
        return [*numeric, *categorical]
    indexer = prep.stages[0]
    return [*numeric, *[f"{c}_{v}" for c, labels in zip(categorical, indexer.labelsArray, strict=True) for v in labels]]


def _one_hot(numeric: list[str], categorical: list[str]) -> Pipeline:
    """Numbers and one-hot categories in a vector."""
    stages, parts = [], list(numeric)
    if categorical:
        indexed = [f"__v_i_{c}" for c in categorical]
        coded = [f"__v_e_{c}" for c in categorical]
        stages.append(StringIndexer(
            inputCols=categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        # The indexer's extra slot for unseen values is the last one, so it is the one dropped.
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True))
        parts += coded
    stages.append(VectorAssembler(inputCols=parts, outputCol="__v"))
    return Pipeline(stages=stages)


def best_round(losses: list[float], patience: int, tol: float = 0.0) -> int:
    """Rounds to keep: up to the lowest loss that ``patience`` further rounds don't undercut by more than ``tol``."""
    best, kept = math.inf, 0
    for k, loss in enumerate(losses, 1):
        if loss < best - tol:
            best, kept = loss, k
        elif k - kept >= patience:
            break
    return max(1, kept)


def fit_member(
    name: str, df: DataFrame, numeric: list[str], categorical: list[str], classes: list[str],
    weights: dict[str, float] | None, params: dict, target: str = S.TARGET, tasks: int = 1,
) -> Member:
    """Fit one member on a prepared, cached frame; rows of a column ``HELD`` are only looked at to end boosting.

    ``catboost`` with categories needs the rows' ``row_id``. Boosting joins the rows into ``tasks``.
    """
    label = literal_map({c: float(i) for i, c in enumerate(classes)})[F.col(target)]
    work = df.withColumn("__y", label)
    params = dict(params)
    patience, tol = params.pop("patience", 0), params.pop("validationTol", 0.0)
    held = HELD if params.pop("heldShare", 0) else None
    weight = None
    if weights is not None:
        weight = "__w"
        work = work.withColumn("__w", literal_map(weights)[F.col(target)])
    if name == "rf":
        params.pop("summedGain", None)
        prep = _one_hot(numeric, categorical).fit(work)
        extra = {"weightCol": weight} if weight else {}
        forest = RandomForestClassifier(featuresCol="__v", labelCol="__y", **params, **extra)
        return Member(name, classes, numeric, categorical, prep, forest.fit(prep.transform(work)))

    known = work.where(~F.col(HELD)) if held else work
    nominal: dict[int, int] = {}
    if name == "catboost":
        encoding = TargetShares.fit(known, categorical, "__y", len(classes))
        told = [f"__t{k}" for k in range(len(categorical) * len(classes))]
        if categorical:
            work = encoding.ordered(work, S.ROW_ID, "__y", int(params.get("seed", 42)), told, held)
        vector = F.array(*[F.col(c) for c in [*numeric, *told]])
    else:
        encoding = CategoryCodes.fit(known, categorical)
        nominal = {len(numeric) + k: n for k, n in enumerate(encoding.sizes())}
        vector = _numbers(numeric, encoding)
    features = len(numeric) + len(categorical) * (len(classes) if name == "catboost" else 1)
    kept = [c for c in ("__y", weight, held) if c]
    boosted = boosting.fit(
        work.select(vector.cast("array<double>").alias("__x"), *kept), settings(name, params, len(classes), features), nominal, "__x", "__y", weight, held,
        tasks=tasks)
    if held:
        boosted = boosted.first(best_round(boosted.losses, patience, tol))
    return Member(name, classes, numeric, categorical, encoding, boosted)
