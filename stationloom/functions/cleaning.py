"""Scalar expressions used by cleaning and feature preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationloom import schema as S


def literal_map(pairs: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(col: Column, pairs: dict) -> Column:
    """Value of ``col`` in a constant map; null when absent."""
    return F.try_element_at(literal_map(pairs), col)


def strict_number(col: Column) -> Column:
    """The number a text holds; text that holds none raises, whatever the session's cast mode."""
    bad = F.raise_error(F.concat(F.lit("not a number: "), col)).cast("double")
    return F.when(col.isNotNull() & col.try_cast("double").isNull(), bad).otherwise(col.try_cast("double"))


def code_of(col: Column) -> Column:
    """Leading numeric code of ``"<code> <text>"``; null and ``nan`` give null, other text raises."""
    head = F.substring_index(col, " ", 1)
    return F.when(F.lower(head) != "nan", strict_number(head))


def timezone_region(col: Column) -> Column:
    """First path segment of a time zone, mapped to its region; unmapped gives null."""
    return lookup(F.trim(F.substring_index(col, "/", 1)), S.TIMEZONE_REGIONS)


def landcover_parent(col: Column) -> Column:
    """Code rounded down to its ten-unit parent class."""
    return (F.floor(col / 10) * 10).cast("double")


def without_sentinels(name: str) -> Column:
    """The column with missing-value codes turned into null."""
    codes = S.SENTINELS + ([S.ALTITUDE_SENTINEL] if name == "altitude" else [])
    col = F.col(name)
    return F.when(col.isin(codes), F.lit(None)).otherwise(col).alias(name)


def as_category(col: Column) -> Column:
    """String form of a category, missing spelled out."""
    return F.coalesce(col.cast("string"), F.lit("nan"))


def tidy_category(col: Column) -> Column:
    """Trimmed category text without a trailing ``.0``."""
    return F.regexp_replace(F.trim(as_category(col)), r"\.0$", "")


def lenient_number(col: Column) -> Column:
    """Number where the text is one, else null."""
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def is_labelled(target: str = S.TARGET) -> Column:
    """True unless the label is the unlabelled marker; a null label counts as labelled."""
    return ~F.col(target).eqNullSafe(F.lit(S.UNLABELLED))
