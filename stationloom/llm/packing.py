"""Packing of documents into padded batches, with optimal length buckets.

Documents become sequences of at most ``max_length`` tokens (a longer one is cut into several, nothing is
dropped). A dynamic program over the global histogram of lengths picks the bucket boundaries with the least
padding; in each bucket, batches hold as many sequences as the token budget allows at the bucket's length.
Places in a bucket come from counts per salt, so that no bucket, however large, meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationloom.llm.token_count import token_counts
from stationloom.session import checkpointed

MAX_LENGTH, BUCKETS, BATCH_TOKENS = 4096, 16, 65_536
#: Sequences of a salt, about.
SALT_ROWS = 50_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that pad the least in all.

    ``lengths`` are distinct and ascending. Padding all of a stretch to its longest is a cost that fulfils
    the quadrangle inequality, so each row of the program is filled by divide and conquer: the time is
    buckets x lengths x log lengths.
    """
    n = len(lengths)
    if not n:
        return []
    lengths = np.asarray(lengths, np.float64)
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    # padded size of the lengths i..j-1 is lengths[j - 1] x their rows; the tokens themselves are a constant
    best = np.concatenate([[0.0], lengths * rows[1:]])
    choices = []
    for _ in range(1, min(buckets, n)):
        now, choice = best.copy(), np.zeros(n + 1, np.int64)
        stack = [(1, n, 0, n - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (rows[j] - rows[i])
            k = int(np.argmin(cost))
            now[j], choice[j] = cost[k], i[k]
            stack += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        best = now
        choices.append(choice)
    bounds, j = [], n
    for choice in reversed(choices):
        bounds.append(int(lengths[j - 1]))
        j = int(choice[j])
        if not j:
            break
    if j:
        bounds.append(int(lengths[j - 1]))
    return sorted(bounds)


def sequences(lengths: DataFrame, max_length: int) -> DataFrame:
    """``doc_id, part, first_token, length``: each document's tokens and end mark, cut at ``max_length``."""
    whole = F.col("n_tokens") + 1
    parts = F.ceil(whole / max_length).cast("long")
    cut = lengths.select("doc_id", whole.alias("_whole"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    first = F.col("part") * max_length
    return cut.select("doc_id", "part", first.alias("first_token"), F.least(F.lit(max_length), F.col("_whole") - first).cast("long").alias("length"))


def pack(lengths: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per sequence: ``doc_id, part, first_token, length, bucket, bucket_length, batch, slot, padding``.

    ``lengths`` has ``doc_id, n_tokens``; a null count is 0, and an end mark is added to each document. A batch is
    named by bucket and number, holds at most ``batch_tokens`` tokens with its padding (one sequence at least),
    and is full unless it is the last of its bucket. Ties and repeated rows are placed in any fixed order. An
    empty table gives no rows.
    """
    rows = lengths.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    rows = checkpointed(sequences(rows, max_length))
    # at most max_length rows, whatever the corpus
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()
    bounds = optimal_boundaries(np.array([r["length"] for r in histogram]), np.array([r["n"] for r in histogram]), buckets)
    sizes = [0] * len(bounds)
    for r in histogram:
        sizes[int(np.searchsorted(bounds, r["length"]))] += r["n"]
    bucket = F.lit(None).cast("int")
    for k in reversed(range(len(bounds))):
        bucket = F.when(F.col("length") <= bounds[k], F.lit(k)).otherwise(bucket)
    longest = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds] or [F.lit(0).cast("long")]), F.col("bucket") + 1)
    salts = max(1, -(-max(sizes, default=0) // SALT_ROWS))
    salt = F.pmod(F.xxhash64("doc_id", "part", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    placed = rows.withColumn("bucket", bucket).withColumn("_salt", salt)
    counts = placed.groupBy("bucket", "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("bucket").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("bucket", "_salt", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("bucket", "_salt").orderBy(F.xxhash64("doc_id"), "doc_id", "part")) - 1
    placed = placed.withColumn("_place", place).join(before, ["bucket", "_salt"]).withColumn("_place", F.col("_place") + F.col("_before"))
    placed = placed.withColumn("bucket_length", longest)
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.col("bucket_length")))
    return placed.withColumn("_per", per_batch).select(
        "doc_id", "part", "first_token", "length", "bucket", "bucket_length",
        F.floor(F.col("_place") / F.col("_per")).cast("long").alias("batch"),
        F.pmod("_place", "_per").cast("int").alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )


def pack_documents(docs: DataFrame, model_file: str, **options) -> DataFrame:
    """Count the tokens of whole texts and pack them; null texts are empty, other columns aren't read."""
    return pack(token_counts(docs, model_file).select("doc_id", "n_tokens"), **options)
