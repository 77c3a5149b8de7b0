"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.llm.text import whole_text


@dataclass
class Sample:
    """Texts with their labels, and how often each label occurs among all that may be learnt from."""

    texts: list[str]
    labels: np.ndarray
    totals: dict[int, int]

    @property
    def log_odds(self) -> float:
        """Of label 1 in the whole table."""
        return float(np.log((self.totals.get(1, 0) + 1) / (self.totals.get(0, 0) + 1)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, most: dict[int, int], sample_bytes: int) -> Sample:
    """At most ``most[label]`` documents of each label, ``sample_bytes`` of text in all.

    Ids are taken in the order of their hashes. A text that doesn't fit any more is passed over and the next one
    tried; each label has half of the bytes. Labels other than 0 and 1, null ids and ids held out are no labels; an
    id labelled twice counts once, as its larger label; of rows with one id the longest text counts, of these the
    smallest. Only sizes are looked at before the texts are fetched.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).filter(~held_out)
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    ranked = known.withColumn("_order", F.xxhash64("doc_id"))
    picked = None
    for label, n in most.items():
        part = ranked.filter(F.col("_label") == label).orderBy("_order", "doc_id").limit(n)
        picked = part if picked is None else picked.unionAll(part)
    # as many ids as the parameter says at most, so they may travel to the documents
    sized = docs.select("doc_id", F.octet_length(whole_text()).alias("_size")).join(F.broadcast(picked), "doc_id")
    sized = sized.groupBy("doc_id", "_label", "_order").agg(F.max("_size").alias("_size")).collect()
    left, chosen = dict.fromkeys(most, sample_bytes // 2), []
    for r in sorted(sized, key=lambda r: (r["_order"], str(r["doc_id"]))):
        if r["_size"] <= left[r["_label"]]:
            left[r["_label"]] -= r["_size"]
            chosen.append((r["doc_id"], r["_label"], r["_order"]))
    if not chosen:
        return Sample([], np.empty(0, np.int64), totals)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, _label int, _order long")
    texts = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(-F.octet_length("_text"), "_text", "_label", "_order")).alias("_row"))
    rows = sorted((r["_row"] for r in texts.collect()), key=lambda r: (r["_order"], r["_text"]))
    return Sample([r["_text"] for r in rows], np.array([r["_label"] for r in rows], np.int64), totals)
