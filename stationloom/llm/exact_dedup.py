"""Exact deduplication by recipes of content-defined chunks, in DataFrame operations only.

A text is cut where its own content says so, so equal texts have equal chunks, and so have the
shared parts of different ones. Every distinct chunk gets an identifier that is verified against
all other chunks; from there on a document is its ordered list of identifiers, its recipe, and
only recipes are shuffled and compared. The content of each distinct chunk moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationloom.llm.text import whole_text
from stationloom.session import checkpointed

#: A chunk ends behind a line end, or two letters that are rare together, once it has LEAST
#: characters, and at MOST characters in any case.
LEAST, MOST = 384, 4096
CUT = r"(?:\n|[aeiou][b-df-hj-np-tv-z] [aeiou])"


def chunk_list(text: Column, least: int = LEAST, most: int = MOST, cut: str = CUT) -> Column:
    """The chunks of a text in order; joined they are the text. An empty text has none."""
    whole = f"(?s).{{{least},{most}}}?{cut}|.{{1,{most + least}}}"
    return F.regexp_extract_all(text, F.lit(whole), F.lit(0))


def _identified(rows: DataFrame) -> DataFrame:
    """Add ``recipe``: verified identifiers of the chunks of ``_text``.

    An identifier is the chunk's hash. A hash that distinct chunks share is no identifier yet: the
    ranks of these chunks among each other tell them apart and are added to the recipes concerned.
    """
    rows = rows.withColumn("_chunks", chunk_list(F.col("_text")))
    hashed = F.transform("_chunks", lambda c: F.xxhash64(c))
    chunks = rows.select(F.explode("_chunks").alias("_chunk")).withColumn("_h", F.xxhash64("_chunk"))
    distinct = chunks.distinct()
    shared = distinct.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h")
    shared = checkpointed(shared)
    rows = rows.withColumn("recipe", hashed)
    if shared.isEmpty():
        return rows.drop("_chunks")
    spots = rows.select("_row", F.posexplode("_chunks").alias("_at", "_chunk")).withColumn("_h", F.xxhash64("_chunk"))
    spots = spots.join(shared, "_h", "left_semi").distinct()
    ranks = spots.select("_h", "_chunk").distinct().withColumn(
        "_rank", F.expr("row_number() over (partition by _h order by _chunk)").cast("long"))
    told = (
        spots.join(ranks, ["_h", "_chunk"])
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_at").cast("long").alias("_at"), "_rank"))).alias("_told"))
    )
    flat = F.flatten(F.transform("_told", lambda p: F.array(p["_at"], p["_rank"])))
    joined = rows.join(told, "_row", "left")
    return joined.withColumn("recipe", F.when(F.col("_told").isNull(), F.col("recipe")).otherwise(
        F.concat("recipe", F.array(F.lit(None).cast("long")), flat))).drop("_chunks", "_told")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty. Of equal texts the one with the largest id
    stays; a null id counts as the smallest. Of rows repeated under that id exactly one is ``kept``.
    An empty table gives an empty result. Other columns of ``docs``, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("_text"))
    rows = rows.withColumn("text_sha256", F.sha2("_text", 256))
    # a document's own key, for the rare case in which recipes need more than hashes
    rows = rows.withColumn("_row", F.col("text_sha256"))
    rows = _identified(rows).select("doc_id", "recipe", "text_sha256")
    # repeated rows are counted before anything moves, so a group of copies is as many rows as it has ids
    same = checkpointed(rows.groupBy("recipe", "doc_id", "text_sha256").agg(F.count("*").alias("_times")))
    groups = same.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.sum("_times").alias("group_size"))
    # most recipes are alone: only the others need the join. As a written table they are a plain side of it,
    # so Spark can split a hot recipe's documents over several tasks
    groups = checkpointed(groups.filter("group_size > 1"))
    found = same.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        F.explode(F.expr("sequence(1L, _times)")).alias("_time"),
    )
    return found.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_time") == 1)).alias("kept"),
        "text_sha256",
    )


def unused(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(id_column: Column, sha: Column) -> Column:
    """What tells rows of a table of documents apart: id and text."""
    return F.concat_ws(":", F.coalesce(id_column.cast(T.StringType()), F.lit("null")), sha)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are in ``kept`` (``doc_id, text_sha256``), each once, with all columns."""
    key = unused("_row_key", docs)
    wanted = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.sha2(whole_text(), 256)))
    return keyed.dropDuplicates([key]).join(wanted, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """Documents without exact copies, all columns kept."""
    return keep_rows(docs, exact_dedup(docs).filter("kept"))
