"""From raw documents to packed training sequences, one stage per operator.

Stages: quality classifier, exact dedup, SimHash near-dedup, benchmark decontamination, packing.
Each takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes what a stage returns as
Parquet into the shared folder and reads it again for the next, so a lost executor never costs more
than the stage at hand. Null texts count as empty, repeated rows are copies, empty tables stay empty,
and columns beyond those of ``documents`` travel along untouched until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stationloom.llm import decontaminate, exact_dedup, packing, quality, simhash
from stationloom.llm.queries import PIECE_MODEL, table, tokenizer_file
from stationloom.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    return simhash.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's sequences with their places in padded batches."""
    return packing.pack_documents(docs, tokenizer_file(PIECE_MODEL))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
