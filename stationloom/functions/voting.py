"""Expressions over class probabilities and member predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationloom import schema as S

SUBURBAN = S.CLASSES[1]


def argmax(probs: Column) -> Column:
    """Zero-based position of the largest entry; the lowest position wins a tie."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def majority(preds: Column) -> Column:
    """Most frequent entry of an array; on a tie the one seen first."""
    counts = F.transform(preds, lambda x: F.size(F.filter(preds, lambda y: y.eqNullSafe(x))))
    return F.element_at(preds, F.array_position(counts, F.array_max(counts)).cast("int"))


def confident_class(probs: Column, threshold: float | Column = 0.5) -> Column:
    """Arg-max class if it is suburban or reaches the threshold, otherwise suburban."""
    top = argmax(probs)
    names = F.array(*[F.lit(c) for c in S.CLASSES])
    sure = (top == 1) | (F.array_max(probs) >= threshold)
    return F.when(sure, F.element_at(names, top + 1)).otherwise(F.lit(SUBURBAN))


def top_class_suburban_first(probs: Column) -> Column:
    """Arg-max class where suburban wins every tie, then rural, then urban."""
    rural, suburban, urban = S.CLASSES
    top = F.array_max(probs)
    return (
        F.when(top == probs[1], F.lit(suburban))
        .when(top == probs[0], F.lit(rural))
        .otherwise(F.lit(urban))
    )


def confident_class_suburban_first(probs: Column, threshold: float | Column = 0.5) -> Column:
    """Threshold rule of the grid search: ties go to suburban."""
    cls = top_class_suburban_first(probs)
    return F.when(F.array_max(probs) >= threshold, cls).otherwise(F.lit(SUBURBAN))
