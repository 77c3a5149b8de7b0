"""Compare the members of a bucket with each other, however large the bucket is.

A bucket of more than ``size`` members is cut into blocks, and every pair of its blocks becomes a
group of its own: no group ever holds more than two blocks, and no pair of members is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, key: str, node: str, size: int) -> DataFrame:
    """``rows`` whose ``key`` occurs at least twice, with ``_i`` and ``_j`` naming the pair of blocks."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_members")).filter("_members > 1")
    counts = counts.withColumn("_blocks", F.ceil(F.col("_members") / size).cast("int")).drop("_members")
    own = F.pmod(F.xxhash64(F.col(node)), F.col("_blocks")).cast("int")
    dealt = rows.join(counts, key).withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop(
        "_own", "_other", "_blocks")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by ``keys``: tables that hold whole groups only, many small ones at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = group_starts(table, keys)[-1]
        if last:
            yield table.slice(0, last).combine_chunks()
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of equal keys begins."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def compare_groups(dealt: DataFrame, key: str, compare: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``compare`` on whole groups of what ``in_blocks`` gave: a table sorted by group, and where groups begin and end."""
    keys = [key, "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            yield from compare(table, np.append(group_starts(table, keys), table.num_rows))

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
