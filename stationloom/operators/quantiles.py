"""Exact order statistics without gathering a column in one place.

``percentile`` keeps all distinct values of a group in one buffer. Here a sketch gives a
narrow bracket around each wanted rank, exact counts confirm on which side of it the rank
lies, and the search goes on inside. Only once a bracket holds few rows are those
gathered. Every pass is a map-side aggregate; a value that fills a third of the column
is recognised by its counts and ends the search at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GATHER_LIMIT = 200_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """Open interval that holds one wanted rank."""

    key: str
    rank: int
    inside: int
    below: int = 0
    lo: float | int | None = None
    hi: float | int | None = None
    value: float | int | None = None
    found: bool = False
    bracket: list = field(default_factory=list)

    def within(self, col: Column) -> Column:
        cond = col.isNotNull()
        if self.lo is not None:
            cond = cond & (col > self.lo)
        if self.hi is not None:
            cond = cond & (col < self.hi)
        return cond

    def narrow(self, a_lt: int, a_le: int, b_lt: int, b_le: int) -> None:
        a, b = self.bracket
        top = self.below + self.inside
        if a_lt <= self.rank < a_le:
            self.value, self.found = a, True
        elif b_lt <= self.rank < b_le:
            self.value, self.found = b, True
        elif self.rank < a_lt:
            self.hi, self.inside = a, a_lt - self.below
        elif self.rank < b_lt:
            self.lo, self.hi, self.below, self.inside = a, b, a_le, b_lt - a_le
        else:
            self.lo, self.below, self.inside = b, b_le, top - b_le


def exact_ranks(
    df: DataFrame,
    columns: dict[str, Column],
    wanted: Callable[[str, int], list[int]],
    gather_limit: int = GATHER_LIMIT,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, tuple[int, dict[int, float | int]]]:
    """Count of non-null values and the values at the wanted zero-based ranks, per column."""
    alias = {key: f"v{i}" for i, key in enumerate(columns)}
    frame = df.select(*[c.alias(alias[k]) for k, c in columns.items()])
    for f in frame.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            frame = frame.withColumn(f.name, F.nanvl(f.name, F.lit(None).cast("double")))
    sizes = frame.agg(*[F.count(a).alias(a) for a in alias.values()]).first()
    out = {k: (sizes[a], {}) for k, a in alias.items()}
    searches = [
        _Search(k, r, sizes[a])
        for k, a in alias.items() if sizes[a]
        for r in sorted(set(wanted(k, sizes[a])))
    ]

    def wide() -> list[_Search]:
        return [s for s in searches if not s.found and s.inside > gather_limit]

    while active := wide():
        # Ranks that share an interval share a sketch, and equal edges are counted once.
        spans: dict[tuple, list[_Search]] = {}
        for s in active:
            spans.setdefault((s.key, s.lo, s.hi), []).append(s)
        reach = 2.0 / accuracy
        sketches = []
        for i, group in enumerate(spans.values()):
            col = F.col(alias[group[0].key])
            places = [(s.rank - s.below) / max(s.inside - 1, 1) for s in group]
            probs = [F.lit(p) for at in places for p in (max(0.0, at - reach), min(1.0, at + reach))]
            sketches.append(
                F.percentile_approx(F.when(group[0].within(col), col), F.array(*probs), accuracy).alias(f"s{i}"))
        guess = frame.agg(*sketches).first()
        for i, group in enumerate(spans.values()):
            for j, s in enumerate(group):
                s.bracket = list(guess[f"s{i}"][2 * j:2 * j + 2])
        edges = list(dict.fromkeys((s.key, edge) for s in active for edge in s.bracket))
        exact = frame.agg(*[
            F.count_if(compare(F.col(alias[key]), edge)).alias(f"c{i}_{name}")
            for i, (key, edge) in enumerate(edges)
            for name, compare in (("lt", lambda c, e: c < e), ("le", lambda c, e: c <= e))
        ]).first()
        slot = {e: i for i, e in enumerate(edges)}
        for s in active:
            s.narrow(*[exact[f"c{slot[(s.key, edge)]}_{name}"] for edge in s.bracket for name in ("lt", "le")])

    pending = [s for s in searches if not s.found]
    if pending:
        spans = list({(s.key, s.lo, s.hi): s for s in pending}.values())
        gathered = frame.agg(*[
            F.sort_array(F.collect_list(F.when(s.within(F.col(alias[s.key])), F.col(alias[s.key])))).alias(f"g{i}")
            for i, s in enumerate(spans)
        ])
        slot = {(s.key, s.lo, s.hi): i for i, s in enumerate(spans)}
        picked = gathered.select(*[
            F.element_at(f"g{slot[(s.key, s.lo, s.hi)]}", s.rank - s.below + 1).alias(f"p{i}")
            for i, s in enumerate(pending)
        ]).first()
        for i, s in enumerate(pending):
            s.value = picked[f"p{i}"]
    for s in searches:
        out[s.key][1][s.rank] = s.value
    return out


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float], **options
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring values, nulls ignored."""

    def around(_key: str, n: int) -> list[int]:
        places = [p * (n - 1) for p in probs]
        return [r for x in places for r in (math.floor(x), math.ceil(x))]

    found = exact_ranks(df, columns, around, **options)
    out: dict[str, list[float | None]] = {}
    for key, (n, values) in found.items():
        if n == 0:
            out[key] = [None] * len(probs)
            continue
        row = []
        for p in probs:
            x = p * (n - 1)
            lo, hi = math.floor(x), math.ceil(x)
            a, b = values[lo], values[hi]
            row.append(float(a) if lo == hi else (hi - x) * a + (x - lo) * b)
        out[key] = row
    return out
