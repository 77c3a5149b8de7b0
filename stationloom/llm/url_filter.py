"""URL rules with exact membership from a cascade of Bloom filters.

Every url has a few candidate keys: a suffix of its host and a prefix of its path, for each shape (labels
of the host, length of the path) that some rule has. The distinct candidate keys of the corpus are the
complete key universe. The first filter encodes the listed keys, the second the keys of the universe that
pass the first by mistake, the third the listed keys that pass the second, and so on until no mistake is
left: from then on membership of any key of the universe is exact, and the urls are judged in one pass
over their own columns, without a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom.session import checkpointed

#: Bytes of a level's bits that may be broadcast.
MOST_BYTES = 256 << 20
SEPARATOR = "\x00"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, and paths that begin with ``path``."""

    host: str
    path: str
    verdict: str


# The rules of the query.
RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


@dataclass
class Cascade:
    """Levels of bits; ``contains`` is exact for keys of the universe it was built over."""

    levels: list[tuple[np.ndarray, int, int]] = field(default_factory=list)  # words, bits, hashes per key

    @staticmethod
    def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
        """Bit places of keys at a level, by two 64-bit hashes of each."""
        a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
        for k in range(hashes):
            x = a + b * np.uint64(level * 64 + k + 1)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            yield ((x ^ (x >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)

    def passes(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        words, bits, hashes = self.levels[level]
        out = np.ones(len(h1), bool)
        for at in self.places(h1, h2, level, bits, hashes):
            out &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key belongs to the side whose filter is the last it passes; the first side is the listed one."""
        depth, alive = np.zeros(len(h1), np.int64), np.ones(len(h1), bool)
        for level in range(len(self.levels)):
            left = np.flatnonzero(alive)
            alive[left] = self.passes(h1[left], h2[left], level)
            depth[alive] += 1
        return depth % 2 == 1


def filter_level(keys: DataFrame, n: int, rate: float, level: int, most_bytes: int) -> tuple[np.ndarray, int, int]:
    """Set bits of a level, counted out and merged in Spark; as many words come back as the filter has."""
    hashes = max(1, round(np.log2(1 / rate)))
    bits = max(64, int(np.ceil(n * hashes / np.log(2) / 64)) * 64)
    if bits // 8 > most_bytes:
        raise MemoryError(f"level {level} would take {bits // 8} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            for at in Cascade.places(h1, h2, level, bits, hashes):
                bit = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bit)], ["word", "bit"])

    rows = keys.select("h1", "h2").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return words, bits, hashes


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def build_cascade(universe: DataFrame, listed: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade:
    """A cascade for the distinct ``key``s of ``listed`` over those of ``universe``; both stay in Spark."""
    listed = checkpointed(listed.select("key").distinct().select("key", *hashed(F.col("key"))))
    others = universe.select("key").distinct().join(listed.select("key"), "key", "left_anti")
    others = checkpointed(others.select("key", *hashed(F.col("key"))))
    n, m = listed.count(), others.count()
    cascade, mine, theirs = Cascade(), listed, others
    while n:
        # the first level pays for being small against the universe, the later ones halve what is left
        first = not cascade.levels
        rate = min(0.5, n / (m * np.sqrt(2))) if first and m else 0.5
        cascade.levels.append(filter_level(mine, n, max(rate, 2.0**-40), len(cascade.levels), most_bytes))
        shared = universe.sparkSession.sparkContext.broadcast(cascade)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                net = shared.value
                yield batch.filter(pa.array(net.passes(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), len(net.levels) - 1)))

        passed = checkpointed(theirs.mapInArrow(run, theirs.schema))
        mine, theirs = passed, mine
        n, m = passed.count(), n
        if len(cascade.levels) > 200:
            raise RuntimeError("two keys share both hashes, so no filter tells them apart")
    return cascade


def _shapes(rules: list[Rule]) -> list[tuple[int, int]]:
    """Labels of the host and characters of the path that rules have, the longest first."""
    return sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}, reverse=True)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """One struct per shape: the key's host and path. A shorter host or path gives another shape's key, which no rule of this shape equals."""
    return F.array(*[
        F.struct(F.substring_index(host, ".", -labels).alias("host"), F.substring(path, 1, length).alias("path"))
        for labels, length in shapes])


def _key(c: Column) -> Column:
    return F.concat(c["host"], F.lit(SEPARATOR), c["path"])


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url",
                most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The longest rule that fits decides (characters of host and path together; then of the host; a key with
    both verdicts is blocked). A url without a fitting rule is a key that the cascade doesn't list: its
    verdict is ``default`` and its rule null. Null urls, and those without ``://``, have an empty host and
    path. Repeated rows each give a row, an empty table none; other columns aren't read.
    """
    spark = pages.sparkSession
    shapes = _shapes(rules)
    rows = pages.select(F.col(id_column).alias("page_id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    kind = rows.schema["page_id"].dataType.simpleString()
    if not rules:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keyed = rows.withColumn("_keys", candidates(F.col("host"), F.col("path"), shapes))
    universe = checkpointed(keyed.select(F.explode(F.transform("_keys", _key)).alias("key")).distinct())
    cascades = {}
    blocked = {(r.host, r.path) for r in rules if r.verdict == "block"}
    for verdict in ("block", "allow"):
        listed = [(f"{r.host}{SEPARATOR}{r.path}",) for r in rules if r.verdict == verdict and (verdict == "block" or (r.host, r.path) not in blocked)]
        cascades[verdict] = build_cascade(universe, spark.createDataFrame(listed, "key string"), most_bytes)
    shared = spark.sparkContext.broadcast(cascades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _judged(batch, shared.value, default, len(shapes))

    tried = keyed.select(
        "page_id", "host", "path", F.transform("_keys", lambda c: F.concat(c["host"], c["path"])).alias("_names"),
        F.transform("_keys", lambda c: F.length(c["host"]) * 4096 + F.length(c["path"]) * 4095).cast("array<long>").alias("_sizes"),
        F.transform("_keys", lambda c: F.xxhash64(_key(c))).alias("_h1"), F.transform("_keys", lambda c: F.xxhash64(_key(c), F.lit(1))).alias("_h2"))
    return tried.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judged(batch: pa.RecordBatch, cascades: dict[str, Cascade], default: str, shapes: int) -> pa.RecordBatch:
    n = batch.num_rows
    h1, h2, sizes = (batch.column(c).flatten().to_numpy() for c in ("_h1", "_h2", "_sizes"))
    block = cascades["block"].contains(h1, h2)
    listed = (block | cascades["allow"].contains(h1, h2)).reshape(n, shapes)
    size = np.where(listed, sizes.reshape(n, shapes), -1)
    best = size.argmax(axis=1) if n else np.empty(0, np.int64)
    at = np.arange(n) * shapes + best
    fits = size.reshape(-1)[at] >= 0
    names = batch.column("_names").flatten().take(pa.array(at))
    verdict = np.where(fits, np.where(block[at], "block", "allow"), default)
    rule = pa.compute.if_else(pa.array(fits), names, pa.scalar(None, pa.string()))
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in ("page_id", "host", "path")), rule, pa.array(verdict.astype(object), pa.string())],
        ["page_id", "host", "path", "rule", "verdict"])
