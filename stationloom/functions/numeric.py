"""Numeric expressions with learned constants."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(col: Column, lo: float, hi: float) -> Column:
    """Bound a value; null stays null."""
    return F.when(col < lo, F.lit(lo)).when(col > hi, F.lit(hi)).otherwise(col)


def yeo_johnson(col: Column, lam: float | Column) -> Column:
    """Yeo-Johnson power transform; lambda is a constant or a column."""
    fixed = not isinstance(lam, Column)
    log_up, log_down = F.log1p(col), -F.log1p(-col)
    near = lambda value: abs(lam - value) < 1e-12 if fixed else F.abs(lam - value) < 1e-12
    pow_up = lambda: (F.pow(col + 1.0, F.lit(lam) if fixed else lam) - 1.0) / lam
    pow_down = lambda: -(F.pow(1.0 - col, F.lit(2.0 - lam) if fixed else 2.0 - lam) - 1.0) / (2.0 - lam)
    if fixed:
        upper = log_up if near(0.0) else pow_up()
        lower = log_down if near(2.0) else pow_down()
    else:
        upper = F.when(near(0.0), log_up).otherwise(pow_up())
        lower = F.when(near(2.0), log_down).otherwise(pow_down())
    return F.when(col >= 0, upper).when(col < 0, lower)


def shift_scale(col: Column, shift: float, scale: float) -> Column:
    """``(x - shift) / scale`` with a unit divisor for a degenerate scale."""
    divisor = scale if scale and math.isfinite(scale) else 1.0
    return (col - shift) / divisor
