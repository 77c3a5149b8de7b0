"""Imputation: means, modes and chained equations."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.operators import boosting, forest
from stationloom.operators.transforms import replaced
from stationloom.session import checkpointed

TREE_ESTIMATORS = ("rf", "lgbm", "cboost")
#: Missing-value patterns up to which the linear chain works on one matrix per pattern.
MAX_PATTERNS = 256


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Mean of each column that has values."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, float | str]:
    """Most frequent value per column; the smallest wins a tie.

    All columns of a type are counted in one pass; one winner per column comes back.
    """
    kinds: dict[str, list[str]] = {}
    for name, kind in df.select(*columns).dtypes if columns else []:
        kinds.setdefault(kind, []).append(name)
    modes = {}
    for names in kinds.values():
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])
        counts = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("column", "value").count()
        winner = F.min(F.struct(-F.col("count"), F.col("value").alias("value")))
        for r in counts.groupBy("column").agg(winner.alias("w")).collect():
            modes[r["column"]] = r["w"]["value"]
    return {c: modes[c] for c in columns if c in modes}


def fill(df: DataFrame, values: dict[str, float | str]) -> DataFrame:
    """Replace nulls by learned constants."""
    return replaced(df, {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if c in df.columns})


# -- chained linear equations -----------------------------------------------------------


@dataclass
class Step:
    """One regression of the chain: target column, weights on all columns, intercept."""

    target: int
    weights: np.ndarray
    intercept: float


@dataclass
class LinearChain:
    """Fitted chain: starting means and the regressions in the order they ran."""

    columns: list[str]
    means: list[float]
    steps: list[Step]

    def to_state(self) -> dict:
        return {
            "columns": self.columns, "means": list(self.means),
            "steps": [[s.target, s.weights.tolist(), s.intercept] for s in self.steps],
        }

    @classmethod
    def from_state(cls, state: dict) -> LinearChain:
        return cls(state["columns"], state["means"], [Step(t, np.array(w), b) for t, w, b in state["steps"]])

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill nulls by replaying the regressions on Arrow batches."""
        cols, means = [c for c in self.columns if c in df.columns], dict(zip(self.columns, self.means, strict=True))
        if not self.steps or len(cols) < len(self.columns):
            return fill(df, {c: means[c] for c in cols})
        start = np.array(self.means)
        steps = [(s.target, s.weights, s.intercept) for s in self.steps]
        names = self.columns
        kind = "struct<" + ",".join(f"`{c}`:double" for c in names) + ">"

        @F.pandas_udf(kind)
        def replay(block: pd.DataFrame) -> pd.DataFrame:
            x = block.to_numpy(dtype=float, na_value=np.nan)
            gaps = np.isnan(x)
            x = np.where(gaps, start, x)
            some = np.flatnonzero(gaps.any(axis=1))
            part, holes = x[some], gaps[some]
            for target, weights, intercept in steps:
                at = holes[:, target]
                if at.any():
                    part[at, target] = part[at] @ weights + intercept
            x[some] = part
            return pd.DataFrame(x, columns=names)

        filled = df.withColumn("__filled", replay(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))
        return filled.select(*[F.col(f"__filled.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def bayesian_ridge(
    gram: np.ndarray, moment: np.ndarray, energy: float, n: float, rounds: int = 300, tol: float = 1e-3
) -> np.ndarray:
    """Ridge weights with evidence-maximised precisions.

    Works on centred sufficient statistics ``X'X``, ``X'y``, ``y'y`` and the row count. The
    gamma priors on both precisions have shape and rate 1e-6.
    """
    prior = 1e-6
    eigen, basis = np.linalg.eigh(gram)
    eigen = np.clip(eigen, 0.0, None)
    rotated = basis.T @ moment
    noise = 1.0 / (energy / n + np.finfo(float).eps)
    weight = 1.0
    coef = previous = None
    for _ in range(rounds):
        coef = basis @ (rotated / (eigen + weight / noise))
        rss = max(energy - 2 * coef @ moment + coef @ gram @ coef, 0.0)
        used = float(np.sum(noise * eigen / (weight + noise * eigen)))
        weight = (used + 2 * prior) / (coef @ coef + 2 * prior)
        noise = (n - used + 2 * prior) / (rss + 2 * prior)
        if previous is not None and np.abs(previous - coef).sum() < tol:
            break
        previous = coef
    return basis @ (rotated / (eigen + weight / noise))


def _pattern(columns: list[str]) -> Column:
    """Missing-value pattern of a row as text, ``1`` for a gap."""
    return F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])


def _pattern_moments(df: DataFrame, columns: list[str], means: np.ndarray) -> dict[tuple, np.ndarray]:
    """Second-moment matrix of ``(1, x - mean)`` per missing-value pattern, in one pass.

    A row only contributes through its pattern's matrix, whatever the chain does later.
    """
    d = len(columns)
    z = [F.coalesce(F.col(c).cast("double") - F.lit(float(m)), F.lit(0.0)) for c, m in zip(columns, means, strict=True)]
    sums = [F.count("*").alias("n")]
    sums += [F.sum(z[i]).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for row in df.groupBy(_pattern(columns).alias("pattern")).agg(*sums).collect():
        m = np.zeros((d + 1, d + 1))
        m[0, 0] = row["n"]
        for i in range(d):
            m[0, i + 1] = m[i + 1, 0] = row[f"s{i}"]
            for j in range(i, d):
                m[i + 1, j + 1] = m[j + 1, i + 1] = row[f"p{i}_{j}"]
        out[tuple(ch == "1" for ch in row["pattern"])] = m
    return out


def _regression(total: np.ndarray, t: int, means: np.ndarray) -> tuple[np.ndarray, Step]:
    """Regression of column ``t`` from second moments, on ``(1, z)`` and as a step on plain values."""
    d = len(means)
    n = total[0, 0]
    first = total[0, 1:] / n
    cov = total[1:, 1:] - n * np.outer(first, first)
    rest = [i for i in range(d) if i != t]
    coef = bayesian_ridge(cov[np.ix_(rest, rest)], cov[rest, t], cov[t, t], n)
    row = np.zeros(d + 1)
    row[0] = first[t] - coef @ first[rest]
    row[[i + 1 for i in rest]] = coef
    return row, Step(int(t), row[1:].copy(), float(row[0] + means[t] - row[1:] @ means))


def fit_linear_chain(
    df: DataFrame, columns: list[str], rounds: int = 10, tol: float = 1e-3, max_patterns: int = MAX_PATTERNS
) -> LinearChain:
    """Chained Bayesian-ridge imputation.

    Every imputed value is an affine function of a row's observed values, and which one
    depends only on the row's missing pattern. Where the rows have at most ``max_patterns``
    patterns, the regressions of all rounds follow from the patterns' moment matrices, in four
    passes over the data. With more of them the chain runs over the rows themselves, one job per
    regression; then the driver holds a single matrix. Either way the chain ends with the first
    round that moves no row by the tolerance.
    """
    d = len(columns)
    stats = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.max(F.abs(c)).alias(f"x{i}") for i, c in enumerate(columns)],
        F.count("*").alias("n"),
    ).first()
    means = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    gaps = [stats["n"] - stats[f"n{i}"] for i in range(d)]
    order = [int(i) for i in np.argsort(gaps, kind="stable") if 0 < gaps[i] < stats["n"]]
    if not order or d < 2:
        return LinearChain(list(columns), means.tolist(), [])
    smallest = tol * max(stats[f"x{i}"] or 0.0 for i in range(d))
    # Up to log2(max_patterns) incomplete columns can't have more patterns, so nothing is counted.
    incomplete = sum(g > 0 for g in gaps)
    few = 2**incomplete <= max_patterns or (
        df.select(_pattern(columns)).distinct().limit(max_patterns + 1).count() <= max_patterns)
    run = _chain_of_patterns if few else _chain_of_rows
    return LinearChain(list(columns), means.tolist(), run(df, columns, means, order, rounds, smallest))


def _chain_of_patterns(
    df: DataFrame, columns: list[str], means: np.ndarray, order: list[int], rounds: int, smallest: float
) -> list[Step]:
    """All rounds from one moment matrix per pattern."""
    moments = _pattern_moments(df, columns, means)
    # maps[p] turns the observed (1, z) of pattern p into the current completed (1, z).
    maps = {p: np.diag([1.0, *[0.0 if hole else 1.0 for hole in p]]) for p in moments}
    steps: list[Step] = []
    history = [{p: m.copy() for p, m in maps.items()}]
    for _ in range(rounds):
        for t in order:
            row, step = _regression(sum(maps[p] @ moments[p] @ maps[p].T for p in moments if not p[t]), t, means)
            for p, m in maps.items():
                if p[t]:
                    m[t + 1] = row @ m
            steps.append(step)
        history.append({p: m.copy() for p, m in maps.items()})
    moved = _round_shifts(df, columns, means, history)
    last = next((r + 1 for r, shift in enumerate(moved) if shift < smallest), rounds)
    return steps[: last * len(order)]


def _chain_of_rows(
    df: DataFrame, columns: list[str], means: np.ndarray, order: list[int], rounds: int, smallest: float
) -> list[Step]:
    """The chain over centred rows with gaps, completed so far, which each round writes anew.

    A job replays the steps of the present round on its rows and adds up one matrix; complete
    rows are added up once. So a task holds a batch, and the driver one matrix and the steps.
    """
    d = len(columns)
    names = [f"z{i}" for i in range(d)]
    centred = df.select(
        *[(F.col(c).cast("double") - F.lit(float(m))).alias(z) for c, m, z in zip(columns, means, names, strict=True)],
        _pattern(columns).alias("holes"), F.lit(0.0).alias("shift"))
    complete = F.col("holes") == "0" * d
    whole = _second_moments(centred.where(complete), names, [], None)
    state = checkpointed(centred.where(~complete).fillna(0.0, subset=names))
    steps: list[Step] = []
    for _ in range(rounds):
        present: list[tuple[int, np.ndarray]] = []
        for t in order:
            row, step = _regression(whole + _second_moments(state, names, present, t), t, means)
            present.append((t, row))
            steps.append(step)
        state = checkpointed(state.mapInPandas(_completed(names, present), state.schema))
        if state.agg(F.max("shift")).first()[0] < smallest:
            break
    return steps


def _replayed(block: pd.DataFrame, names: list[str], present: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows as ``(1, z)`` after the given steps, and where they have gaps."""
    z = np.hstack([np.ones((len(block), 1)), block[names].to_numpy(dtype=float)])
    holes = np.frombuffer("".join(block["holes"]).encode(), dtype=np.uint8).reshape(len(block), len(names)) == ord("1")
    for target, row in present:
        at = holes[:, target]
        z[at, target + 1] = z[at] @ row
    return z, holes


def _completed(names: list[str], present: list[tuple[int, np.ndarray]]):
    def run(batches):
        for block in batches:
            z, _ = _replayed(block, names, present)
            moved = np.abs(z[:, 1:] - block[names].to_numpy(dtype=float)).sum(axis=1)
            yield pd.DataFrame(z[:, 1:], columns=names).assign(holes=block["holes"].to_numpy(), shift=moved)
    return run


def _second_moments(
    frame: DataFrame, names: list[str], present: list[tuple[int, np.ndarray]], target: int | None
) -> np.ndarray:
    """Second moments of ``(1, z)`` after the given steps, over rows in which ``target`` is observed."""
    size = len(names) + 1

    def add_up(batches):
        total = np.zeros((size, size))
        for block in batches:
            if len(block):
                z, holes = _replayed(block, names, present)
                if target is not None:
                    z = z[~holes[:, target]]
                total += z.T @ z
        yield pd.DataFrame({"cell": np.arange(size * size), "part": total.ravel()})

    cells = frame.mapInPandas(add_up, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(size * size)
    for cell in cells:
        out[cell["cell"]] = cell["part"]
    return out.reshape(size, size)


def _round_shifts(df: DataFrame, columns: list[str], means: np.ndarray, history: list[dict]) -> list[float]:
    """Largest absolute row sum of change per round, over all rows with gaps."""
    deltas = {
        p: [history[r + 1][p] - history[r][p] for r in range(len(history) - 1)] for p in history[0] if any(p)
    }
    rounds = len(history) - 1

    def shifts(batches):
        top = np.zeros(rounds)
        for pdf in batches:
            x = pdf.to_numpy(dtype=float, na_value=np.nan)
            gaps = np.isnan(x)
            z = np.where(gaps, 0.0, x - means)
            z = np.hstack([np.ones((len(z), 1)), z])
            patterns, inverse = np.unique(gaps, axis=0, return_inverse=True)
            for i, p in enumerate(patterns):
                change = deltas.get(tuple(bool(v) for v in p))
                if change is None:
                    continue
                rows = z[inverse.ravel() == i]
                for r, m in enumerate(change):
                    top[r] = max(top[r], np.abs(rows @ m.T).sum(axis=1).max())
        yield pd.DataFrame({"round": np.arange(rounds), "shift": top})

    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found = numbers.mapInPandas(shifts, "round int, shift double").groupBy("round").agg(F.max("shift").alias("shift"))
    by_round = {r["round"]: r["shift"] for r in found.collect()}
    return [by_round.get(r, 0.0) for r in range(rounds)]


# -- chained trees ------------------------------------------------------------------------


#: Rows of a task that boosts, at least, and of one of Spark's forests; memory of a forest's task for one pass over the rows.
TASK_ROWS, FOREST_ROWS, FOREST_MB = 200_000, 20_000, 1024


def tree_regressor(kind: str, **params):
    """What fits one column: a Spark forest, or settings for boosting, by default of the libraries' sizes.

    A forest of unlimited depth has Spark's deepest, 30. Names of parameters are Spark's.
    """
    if kind == "rf":
        return RandomForestRegressor(**{"numTrees": 100, "maxDepth": 30, "seed": 42, "maxMemoryInMB": FOREST_MB, **params})
    names = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "row_share"}
    given = {names.get(k, k): v for k, v in params.items()}
    if kind == "lgbm":
        return boosting.Settings(1, **{"rounds": 100, "depth": 30, "leaves": 31, "rate": 0.1, "min_rows": 20, "min_weight": 1e-3, **given})
    if kind == "cboost":
        return boosting.Settings(1, **{"rounds": 1000, "depth": 6, "symmetric": True, "rate": 0.1, "l2": 3.0, **given})
    raise NotImplementedError(f"no imputer named {kind!r}; there are None, {', '.join(TREE_ESTIMATORS)}")


@dataclass
class TreeChain:
    """Chained imputation with tree regressors: starting means and ``(target, model)`` steps."""

    columns: list[str]
    means: dict[str, float]
    steps: list[tuple[str, object]]

    @property
    def of_spark(self) -> bool:
        """Whether the steps are models of Spark."""
        return any(not isinstance(m, (boosting.Boosted, forest.Forest)) for _, m in self.steps)

    @property
    def of_forests(self) -> bool:
        """Whether the steps are forests whose trees lie in the shared folder."""
        return any(isinstance(m, forest.Forest) for _, m in self.steps)

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill nulls by running the fitted models in order.

        Boosted steps are replayed batch by batch, so the plan has one step however long the chain. Forests answer for the
        rows with gaps, a job for each. Where they are models of Spark, what they have filled is written to the shared
        folder after every few of them.
        """
        flags = {c: f"__gap_{c}" for c in {t for t, _ in self.steps}}
        if not flags:
            return fill(df, self.means)
        if self.of_forests:
            return self._through_forests(df)
        if not self.of_spark:
            return self._replayed(df)
        work = fill(df.withColumns({f: F.col(c).isNull() for c, f in flags.items()}), self.means)
        for k, (target, model) in enumerate(self.steps, 1):
            work = _forest_step(work, self.columns, target, flags[target], model)
            if k % FORESTS_AT_ONCE == 0:
                work = checkpointed(work)
        return work.drop(*flags.values())

    def _replayed(self, df: DataFrame) -> DataFrame:
        names, start = self.columns, np.array([self.means[c] for c in self.columns])
        shared = df.sparkSession.sparkContext.broadcast([(names.index(t), m) for t, m in self.steps])
        kind = "struct<" + ",".join(f"`{c}`:double" for c in names) + ">"

        @F.pandas_udf(kind)
        def replay(block: pd.DataFrame) -> pd.DataFrame:
            x = block.to_numpy(dtype=float, na_value=np.nan)
            gaps = np.isnan(x)
            x = np.where(gaps, start, x)
            for target, model in shared.value:
                at = np.flatnonzero(gaps[:, target])
                if len(at):
                    x[at, target] = model.margins(np.delete(x[at], target, axis=1))[:, 0]
            return pd.DataFrame(x, columns=names)

        filled = df.withColumn("__filled", replay(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))
        return filled.select(*[F.col(f"__filled.{c}").alias(c) if c in names else F.col(c) for c in df.columns])

    def _through_forests(self, df: DataFrame) -> DataFrame:
        """The rows are written to the shared folder once. Those with gaps are packed into blocks, a row for each, which
        meet the trees of one step after the other; the answers of the trees are added up by block."""
        names, start = self.columns, np.array([self.means[c] for c in self.columns])
        rows = checkpointed(df.withColumns({c: F.col(c).cast("double") for c in names}).withColumn(AT, F.monotonically_increasing_id()))
        gaps = {c: F.col(c).isNull() | F.isnan(c) for c in names}
        any_gap = reduce(lambda a, b: a | b, gaps.values())
        some = rows.where(any_gap)
        counts = some.agg(F.count("*").alias("n"), *[F.count_if(g).alias(f"g{i}") for i, g in enumerate(gaps.values())]).first()
        if not counts["n"]:
            return rows.drop(AT)
        tasks = math.ceil(counts["n"] / BLOCK_ROWS)
        shares = math.ceil(df.sparkSession.sparkContext.defaultParallelism / tasks)  # of a forest, for each task's blocks
        blocks = checkpointed(some.coalesce(tasks).select(AT, *names).mapInArrow(_blocks(start), _BLOCK))
        for target, model in self.steps:
            at = names.index(target)
            if counts[f"g{at}"]:
                # nothing is broadcast, as that would gather the trees
                pairs = blocks.select("block", "x", "holes").crossJoin(model.table().coalesce(shares).hint("shuffle_replicate_nl"))
                answers = pairs.mapInArrow(_answers(len(names), at, model.binning), "block long, k long, given binary")
                both = blocks.withColumn("k", F.lit(-1).cast("long")).unionByName(answers, allowMissingColumns=True)
                ordered = both.repartition(tasks, "block").sortWithinPartitions("block", "k").coalesce(tasks)
                blocks = checkpointed(ordered.mapInArrow(_added(len(names), at, model.count), _BLOCK))
        filled = [f"__{i}" for i in range(len(names))]
        found = blocks.mapInArrow(_unpacked(len(names)), f"{AT} long, " + ", ".join(f"{c} double" for c in filled))
        whole = some.join(found, AT).withColumns({c: F.col(z) for c, z in zip(names, filled, strict=True)})
        return rows.where(~any_gap).select(*df.columns).unionByName(whole.select(*df.columns))

    def to_state(self) -> dict:
        """Of a chain without models of Spark. Of forests it says where they are."""
        return {"columns": self.columns, "means": self.means, "steps": [[t, isinstance(m, forest.Forest), m.to_state()] for t, m in self.steps]}

    @classmethod
    def from_state(cls, state: dict) -> TreeChain:
        def model(mean: bool, m: dict):
            return (boosting.Boosted if not mean else forest.Gathered if "rounds" in m else forest.Forest).from_state(m)
        return cls(state["columns"], state["means"], [(t, model(mean, m)) for t, mean, m in state["steps"]])

    def stored(self, folder: str) -> dict:
        """The state with all forests below ``folder``, from where it can be moved."""
        steps = [(t, replace(m.copied(f"{folder}/{k}"), path=str(k)) if isinstance(m, forest.Forest) else m) for k, (t, m) in enumerate(self.steps)]
        return replace(self, steps=steps).to_state()

    @classmethod
    def restored(cls, state: dict, folder: str) -> TreeChain:
        """The chain of a state that ``stored`` has given."""
        chain = cls.from_state(state)
        return replace(chain, steps=[(t, replace(m, path=f"{folder}/{m.path}") if isinstance(m, forest.Forest) else m) for t, m in chain.steps])


#: Number of a row, and rows of a block, at most; a block is its rows' numbers, values and gaps.
AT, BLOCK_ROWS = "__at", 10_000
_BLOCK = "block long, at binary, x binary, holes binary"


def _blocks(start: np.ndarray):
    """Rows packed into blocks, gaps filled with ``start``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                at, *x = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                x = np.column_stack(x)
                holes = np.isnan(x)
                yield _block(number, at.tobytes(), np.where(holes, start, x).tobytes(), holes.tobytes())
                number += 1
    return run


def _block(number: int, *parts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([p], pa.binary()) for p in parts]], ["block", "at", "x", "holes"])


def _matrices(x: bytes, holes: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x).reshape(-1, width).copy(), np.frombuffer(holes, bool).reshape(-1, width)


def _answers(width: int, at: int, binning: boosting.Binning):
    """What a tree gives for the rows of a block that have a gap at ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bins = None, None
        for batch in batches:
            number, x, holes, k, tree = batch.columns
            for i in range(batch.num_rows):
                if number[i].as_py() != last:
                    last = number[i].as_py()
                    full, gaps = _matrices(x[i].as_py(), holes[i].as_py(), width)
                    bins = binning.apply(np.delete(full[gaps[:, at]], at, axis=1))
                given = pickle.loads(tree[i].as_py()).predict(bins).tobytes()
                yield pa.RecordBatch.from_arrays([number.slice(i, 1), k.slice(i, 1), pa.array([given], pa.binary())], ["block", "k", "given"])
    return run


def _added(width: int, at: int, trees: int):
    """Blocks with the mean of their answers, which follow them, in the gaps at ``at``."""
    def finished(number: int, rows: bytes, x: bytes, holes: bytes, total: np.ndarray) -> pa.RecordBatch:
        full, gaps = _matrices(x, holes, width)
        full[gaps[:, at], at] = total / trees
        return _block(number, rows, full.tobytes(), holes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            number, rows, x, holes, k, given = batch.columns
            for i in range(batch.num_rows):
                if k[i].as_py() >= 0:
                    total += np.frombuffer(given[i].as_py())
                    continue
                if block is not None:
                    yield finished(*block, total)
                block = [c[i].as_py() for c in (number, rows, x, holes)]
                total = np.zeros(int(np.frombuffer(block[3], bool).reshape(-1, width)[:, at].sum()))
        if block is not None:
            yield finished(*block, total)
    return run


def _unpacked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = [np.frombuffer(at, np.int64), *np.frombuffer(x).reshape(-1, width).T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [AT, *[f"__{i}" for i in range(width)]])
    return run


#: Forests in a plan, at most.
FORESTS_AT_ONCE = 5


def _features(columns: list[str], target: str) -> VectorAssembler:
    return VectorAssembler(inputCols=[c for c in columns if c != target], outputCol="__x")


def _forest_step(df: DataFrame, columns: list[str], target: str, gap: str, model: RandomForestRegressionModel) -> DataFrame:
    scored = model.transform(_features(columns, target).transform(df))
    value = F.when(F.col(gap), F.col(model.getPredictionCol())).otherwise(F.col(target))
    return scored.withColumn(target, value).drop("__x", model.getPredictionCol())


def _without(binning: boosting.Binning, at: int) -> boosting.Binning:
    return boosting.Binning([e for k, e in enumerate(binning.ends) if k != at], [n for k, n in enumerate(binning.sizes) if k != at])


def fit_tree_chain(
    df: DataFrame, columns: list[str], kind: str, rounds: int = 10, tol: float = 1e-3, **params
) -> TreeChain:
    """Chained imputation where each regression is a tree ensemble.

    Lineage is cut through the shared checkpoint folder after every step, so no plan holds more than one model. Bins are
    found once, before the first step. Forests are Spark's where the table is larger than ``forest.MOST_ROWS``; the
    trees of smaller ones stay in the shared folder.
    """
    regressor = tree_regressor(kind, **params)
    means = column_means(df, columns)
    used = [c for c in columns if c in means]
    stats = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(used)],
        *[F.max(F.abs(c)).alias(f"x{i}") for i, c in enumerate(used)],
        F.count("*").alias("n"),
    ).first() if used else {}
    gaps = {c: stats[f"g{i}"] for i, c in enumerate(used)}
    order = sorted([c for c in used if gaps[c]], key=lambda c: gaps[c])
    chain = TreeChain(used, means, [])
    if not order or len(used) < 2:
        return chain
    limit = tol * max(stats[f"x{i}"] or 0.0 for i in range(len(used)))
    flags = {c: f"__gap_{c}" for c in order}
    tasks = max(1, math.ceil(stats["n"] / (FOREST_ROWS if kind == "rf" else TASK_ROWS)))
    work = df.select(*[F.col(c).cast("double").alias(c) for c in used])
    work = checkpointed(fill(work.withColumns({f: F.col(c).isNull() for c, f in flags.items()}), means).coalesce(tasks))
    binning = None
    in_task = stats["n"] <= forest.MOST_ROWS
    if kind != "rf" or in_task:
        binning = boosting.Binning.fit(work, F.array(*used), len(used), {})
    if kind == "rf" and in_task:
        chain.steps = _forest_steps(work, used, order, flags, binning, regressor, rounds, limit)
        return chain
    for _ in range(rounds):
        before = {c: f"__old_{c}" for c in order}
        work = work.withColumns({b: F.col(c) for c, b in before.items()})
        for target in order:
            known = work.where(~F.col(flags[target]))
            rest = [c for c in used if c != target]
            if kind == "rf":
                trees = regressor.setFeaturesCol("__x").setLabelCol(target).setPredictionCol(f"__p_{len(chain.steps)}")
                model = trees.fit(_features(used, target).transform(known))
                filled = _forest_step(work, used, target, flags[target], model)
            else:
                model = boosting.fit(
                    known.select(F.array(*rest).alias("__x"), target), replace(regressor, seed=regressor.seed + len(chain.steps)), None, "__x", target,
                    binning=_without(binning, used.index(target)), tasks=tasks)
                # only rows with a gap go through Python
                predicted = boosting.predicted(model, F.when(F.col(flags[target]), F.array(*rest)))
                filled = work.withColumn(target, F.when(F.col(flags[target]), predicted).otherwise(F.col(target)))
            chain.steps.append((target, model))
            work = checkpointed(filled)
        total = sum((F.abs(F.col(c) - F.col(b)) for c, b in before.items()), F.lit(0.0))
        moved = work.agg(F.max(total)).first()[0]
        work = work.drop(*before.values())
        if moved is None or moved < limit:
            break
    return chain


def _forest_steps(
    work: DataFrame, used: list[str], order: list[str], flags: dict[str, str], binning: boosting.Binning, regressor: RandomForestRegressor, rounds: int, limit: float
) -> list[tuple[str, forest.Forest]]:
    """The steps on a table that tasks grow forests on: rows are gathered once, and a step sends back what fills its gaps."""
    table = forest.gathered(work)
    x = np.column_stack([table.column(c).to_numpy() for c in used])
    gaps = {c: table.column(flags[c]).to_numpy() for c in order}
    steps: list[tuple[str, forest.Forest]] = []
    for _ in range(rounds):
        before = x.copy()
        for target in order:
            at, gap = used.index(target), gaps[target]
            rest = np.delete(x, at, axis=1)
            model, given = forest.plant(
                work.sparkSession, rest[~gap], x[~gap, at], rest[gap], _without(binning, at), trees=regressor.getNumTrees(),
                depth=regressor.getMaxDepth(), min_rows=regressor.getMinInstancesPerNode(), seed=regressor.getSeed() + len(steps))
            x[gap, at] = given
            steps.append((target, model))
        if np.abs(x - before).sum(axis=1).max() < limit:
            break
    return steps
