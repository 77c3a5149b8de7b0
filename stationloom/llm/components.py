"""Connected components of a graph that is larger than any one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.session import checkpointed


class UnionFind:
    """Sets of numbers or strings, each named by its smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent, root = self.parent, x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        return True


#: Edges a task thins out at once, before it starts afresh.
_BATCH_EDGES = 500_000


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges in a task, those that connect something, as (member, smallest member)."""
    sets, kind = UnionFind(), None

    def found() -> pa.RecordBatch:
        nodes = list(sets.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([sets.find(x) for x in nodes], kind)], ["a", "b"])

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > _BATCH_EDGES:
            yield found()
            sets = UnionFind()
    if sets.parent:
        yield found()


def components(edges: DataFrame) -> DataFrame:
    """The component of every node that has an edge: ``node, component`` (the smallest node reachable).

    ``edges`` has two columns of long numbers or strings, in any order and any number of times. Large-star and
    small-star rounds alternate until nothing changes; each is a minimum per node (combined before
    the shuffle) and a join, and its result is cut off from its past in the shared folder.
    """
    a, b = edges.columns
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    pairs = checkpointed(pairs.mapInArrow(_thinned, f"a {kind}, b {kind}").distinct())
    state = None
    while True:
        # large star: every larger neighbour goes to the smallest one
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        starred = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        starred = starred.filter("a <> b").distinct()
        # small star: every node and its smaller neighbours go to the smallest of them
        least = starred.groupBy("a").agg(F.min("b").alias("m"))
        joined = starred.join(least, "a")
        pairs = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        pairs = checkpointed(pairs)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
