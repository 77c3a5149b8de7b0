"""Categories as numbers for boosted trees: codes, or class shares that never see a row's own label."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom.functions.cleaning import lookup

#: Levels of a category at most: they travel with the model.
MOST_LEVELS = 65_535
#: Parts of the random order in which rows are counted, so that a hot category isn't one task's.
ORDER_PARTS = 4096


@dataclass
class CategoryCodes:
    """Levels in alphabetical order; what wasn't seen has a code of its own, the last one."""

    levels: dict[str, list[str]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> CategoryCodes:
        return cls({c: known_levels(df, c) for c in columns})

    def expressions(self) -> list[Column]:
        out = []
        for c, levels in self.levels.items():
            codes = {v: float(k) for k, v in enumerate(levels)}
            out.append(F.coalesce(lookup(F.col(c), codes), F.lit(float(len(levels)))) if codes else F.lit(0.0))
        return out

    def sizes(self) -> list[int]:
        return [len(levels) + 1 for levels in self.levels.values()]

    def to_state(self) -> dict:
        return {"levels": self.levels}


@dataclass
class TargetShares:
    """The share of each class among the rows of a level, drawn towards the shares of all rows.

    What a model learns from is ``ordered``: rows come in a random order, and each is told the shares among those
    before it only, so its own label doesn't leak into it. Later rows are told the shares among all.
    """

    shares: dict[str, dict[str, list[float]]]
    overall: list[float]
    weight: float

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], label: str, classes: int, weight: float = 1.0) -> TargetShares:
        counts = {int(r[0]): r[1] for r in df.groupBy(label).count().collect()}
        total = max(1, sum(counts.values()))
        overall = [counts.get(k, 0) / total for k in range(classes)]
        shares: dict[str, dict[str, list[float]]] = {}
        for c in columns:
            known_levels(df, c)
            found: dict[str, np.ndarray] = {}
            for r in df.where(F.col(c).isNotNull()).groupBy(c, label).count().collect():
                found.setdefault(r[0], np.zeros(classes))[int(r[1])] = r[2]
            shares[c] = {v: ((n + weight * np.array(overall)) / (n.sum() + weight)).tolist() for v, n in found.items()}
        return cls(shares, overall, weight)

    def expressions(self) -> list[Column]:
        """Per column one number per class."""
        out = []
        for c, shares in self.shares.items():
            for k, overall in enumerate(self.overall):
                mine = {v: s[k] for v, s in shares.items()}
                out.append(F.coalesce(lookup(F.col(c), mine), F.lit(overall)) if mine else F.lit(overall))
        return out

    def to_state(self) -> dict:
        return {"shares": self.shares, "overall": self.overall, "weight": self.weight}

    def ordered(self, df: DataFrame, row_id: str, label: str, seed: int, names: list[str], held: str | None = None) -> DataFrame:
        """``df`` with the numbers to learn from as columns ``names``, in the order of ``expressions``.

        The order is that of a hash of ``row_id``. It is cut into parts: counts per level and part come first, summed
        over the parts before, and rows are only counted against each other within their part. Rows of ``held``
        are counted for nobody and told the shares among all others.
        """
        classes = len(self.overall)
        counted = ~F.col(held) if held else F.lit(True)
        work = df.withColumn("__o", F.xxhash64(F.col(row_id), F.lit(seed)))
        work = work.withColumn("__part", F.floor(F.col("__o") / (2.0**64 / ORDER_PARTS)).cast("int"))
        place = 0
        for c in self.shares:
            own = names[place : place + classes]
            place += classes
            per_part = work.groupBy(c, "__part").agg(
                *[F.count_if(counted & (F.col(label) == k)).alias(f"__n{k}") for k in range(classes)])
            earlier = Window.partitionBy(c).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
            per_part = per_part.select(
                F.col(c).alias("__level"), F.col("__part").alias("__p"),
                *[F.coalesce(F.sum(f"__n{k}").over(earlier), F.lit(0)).alias(f"__n{k}") for k in range(classes)])
            work = work.join(per_part, F.col(c).eqNullSafe(F.col("__level")) & (F.col("__part") == F.col("__p"))).drop("__level", "__p")
            within = Window.partitionBy(c, "__part").orderBy("__o", row_id).rowsBetween(Window.unboundedPreceding, -1)
            before = [F.col(f"__n{k}") + F.coalesce(F.sum((counted & (F.col(label) == k)).cast("long")).over(within), F.lit(0)) for k in range(classes)]
            work = work.withColumns({f"__b{k}": b for k, b in enumerate(before)})
            total = sum((F.col(f"__b{k}") for k in range(classes)), F.lit(0)) + F.lit(self.weight)
            told = [(F.col(f"__b{k}") + F.lit(self.weight * self.overall[k])) / total for k in range(classes)]
            if held:
                whole = TargetShares({c: self.shares[c]}, self.overall, self.weight).expressions()
                told = [F.when(F.col(held), w).otherwise(t) for w, t in zip(whole, told, strict=True)]
            work = work.withColumns(dict(zip(own, told, strict=True))).drop(*[f"__{x}{k}" for x in "nb" for k in range(classes)])
        return work.drop("__o", "__part")


def known_levels(df: DataFrame, column: str) -> list[str]:
    """The levels of a category, in alphabetical order."""
    found = [r[0] for r in df.select(column).distinct().where(F.col(column).isNotNull()).limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column!r} has over {MOST_LEVELS:,} values, too many for a category")
    return sorted(found)
