"""A paged web source as a Spark data source: one partition per page or batch of codes."""

from __future__ import annotations

import json
import logging
import re
from functools import reduce
from urllib.error import URLError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stationloom import schema as S
from stationloom.sources import records

log = logging.getLogger(__name__)

SOURCE_NAME = "station_pages"


class _Part(InputPartition):
    def __init__(self, urls: list[tuple[int, str]], required: bool, last: bool = False):
        super().__init__(None)
        self.urls = urls
        self.required = required
        self.last = last


class StationPages(DataSource):
    """Records behind a URL template.

    Options: ``url`` with ``{limit}`` and ``{offset}``, plus ``pagesize`` and ``pages``; or with
    ``{code}``, plus ``codes`` as a JSON list. Executors open the addresses with ``urllib``; pages in a
    folder that Spark reads are better read by ``read_pages``. A full last page is warned about, as more may follow.
    """

    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def schema(self) -> str:
        return "row_id bigint, body string"

    def reader(self, schema):
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]
        self.codes = json.loads(options.get("codes", "null"))
        self.size = int(options.get("pagesize", 1000))
        self.pages = int(options.get("pages", 26))
        self.batch = int(options.get("batch", 100))
        self.timeout = float(options.get("timeout", 30))

    def partitions(self):
        if self.codes is None:
            return [
                _Part([(i * self.size, self.url.format(limit=self.size, offset=i * self.size))], True, i == self.pages - 1)
                for i in range(self.pages)
            ]
        urls = [(i, self.url.format(code=quote(c, safe=""))) for i, c in enumerate(self.codes)]
        return [_Part(urls[i:i + self.batch], False) for i in range(0, len(urls), self.batch)]

    def read(self, partition: _Part):
        for first, url in partition.urls:
            try:
                with urlopen(url, timeout=self.timeout) as response:
                    payload = json.load(response)
            except URLError as problem:
                if partition.required:
                    raise
                log.warning("skipped %s: %s", url, problem)
                continue
            found = payload if isinstance(payload, list) else [payload]
            if partition.last and len(found) >= self.size:
                log.warning("the last page asked for is full, so records after %s may be missing", first + len(found))
            for i, record in enumerate(found):
                yield first + i, json.dumps(record)


def _stored_page(spark: SparkSession, url: str, size: int, page: int) -> DataFrame:
    """A page that Spark reads: a JSON list, or one object."""
    text = spark.read.text(url.format(limit=size, offset=page * size), wholetext=True)
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    place = (F.lit(page * size) + F.col("pos")).cast("long").alias("row_id")
    return text.select(F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "body")).select(place, "body")


def _offset_pattern(url: str, size: int) -> str | None:
    """Pattern that finds the offset in the path of a page's file; none where the path's parts don't tell it."""
    if "{offset}" not in url or set("*?[]\\") & set(url) or set("{}") & set(url.format(limit="", offset="")):
        return None
    parts = url.replace("{limit}", str(size)).split("/")
    told = "/".join(parts[next(i for i, p in enumerate(parts) if "{offset}" in p):]).rstrip("/")
    first, *more = [re.escape(text) for text in told.split("{offset}")]
    return ".*/" + first + r"(\d+)" + r"\1".join(more) + "(?:/.*)?$"


def _stored_pages(spark: SparkSession, url: str, size: int, pages: int, pattern: str) -> DataFrame:
    """All pages in one scan; the path of a file tells its page."""
    text = spark.read.text([url.format(limit=size, offset=i * size) for i in range(pages)], wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    offset = F.regexp_extract(path, pattern, 1).cast("long")
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    found = text.select(offset.alias("offset"), F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "body"))
    return found.select((F.col("offset") + F.col("pos")).alias("row_id"), "body")


def read_pages(spark: SparkSession, url: str, page_size: int = 1000, n_pages: int = 26) -> DataFrame:
    """Raw records of the first ``n_pages`` pages; a page that fails raises.

    Web addresses are opened by the executors. Any other template names files or folders, one per page, on
    a store that Spark reads, and is read by Spark, in one scan where the path of a file tells its page.
    """
    if not url.startswith(("http:", "https:")):
        pattern = _offset_pattern(url, page_size)
        if pattern is not None:
            return _stored_pages(spark, url, page_size, n_pages, pattern)
        return reduce(DataFrame.unionAll, [_stored_page(spark, url, page_size, i) for i in range(n_pages)])
    spark.dataSource.register(StationPages)
    reader = spark.read.format(SOURCE_NAME).option("url", url)
    return reader.option("pagesize", page_size).option("pages", n_pages).load()


def first_stations(
    spark: SparkSession, url: str | None = None, page_size: int = 1000, n_pages: int = 26,
    data_points: DataFrame | None = None,
) -> DataFrame:
    """Flat station rows of the first pages, or of records already at hand."""
    raw = data_points if data_points is not None else read_pages(spark, url, page_size, n_pages)
    return records.flatten(raw)


def stations_by_code(spark: SparkSession, url: str, codes: str | list[str], output: str = "dataframe"):
    """Flat rows for a list of codes in request order; codes that fail are skipped.

    ``output="dicts"`` brings the rows to the driver, which suits a short list only.
    """
    if output not in ("dataframe", "dicts"):
        raise ValueError("output must be 'dataframe' or 'dicts'.")
    listed = [codes] if isinstance(codes, str) else list(codes)
    spark.dataSource.register(StationPages)
    raw = spark.read.format(SOURCE_NAME).option("url", url).option("codes", json.dumps(listed)).load()
    names = F.from_json(F.lit(json.dumps(listed)), "array<string>")
    found = records.flatten(raw).withColumnRenamed(S.ROW_ID, "pos")
    found = found.withColumn("requested_code", F.element_at(names, F.col("pos").cast("int") + 1)).orderBy("pos")
    found = found.withColumn(S.ROW_ID, F.col("pos"))
    return [r.asDict() for r in found.drop("requested_code", "pos", S.ROW_ID).collect()] if output == "dicts" else found
