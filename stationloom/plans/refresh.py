"""Full refresh: fetch all pages, flatten, report rejects, write a dated file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stationloom.session import checkpointed
from stationloom.sources import paged, records, sinks


def refresh(
    spark: SparkSession, folder: str, url: str, page_size: int = 1000, n_pages: int = 26
) -> tuple[str, DataFrame]:
    """Path of the written table, and the malformed records.

    The raw records are kept in the shared folder first, so that every page is fetched once.
    """
    raw = checkpointed(paged.read_pages(spark, url, page_size, n_pages))
    path = sinks.write_stamped(records.flatten(raw), folder)
    return path, records.rejects(raw)
