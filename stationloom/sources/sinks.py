"""Sinks for station tables and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom import schema as S

STAMP = "dd.MM.yyyy"


def date_stamp(when: Column | None = None) -> Column:
    """A date as ``dd.MM.yyyy``."""
    return F.date_format(F.current_date() if when is None else when, STAMP)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, without the row id, text kept as it is."""
    plain = df.drop(S.ROW_ID)
    writer = plain.write.mode("overwrite").option("header", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_stamped(df: DataFrame, folder: str, stem: str = "stationglobalmetadata") -> str:
    """CSV under a name that carries today's date; gives back the path."""
    stamp = df.sparkSession.range(1).select(date_stamp().alias("d")).first()["d"]
    path = f"{folder}/{stem}_{stamp}.csv"
    write_csv(df, path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, the better choice for large tables."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def as_dicts(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls spelled out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
