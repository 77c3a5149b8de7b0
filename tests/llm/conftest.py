import re

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own columns
    T.StructField("fp", T.StringType()), T.StructField("row", T.DoubleType()), T.StructField("recipe", T.StringType()),
    T.StructField("_row_key", T.StringType()), T.StructField("_hit", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])
NONE = (None,) * 7


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents with clashing extra columns, from (id, text) pairs."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t), *NONE) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and very long texts, ties, repeated rows and repeated ids."""
    long = " ".join(f"word{k % 977} of {k}" for k in range(40_000))
    return [
        (1, "One two three."), (2, "One two three."), (3, "one two three"), (None, "One two three."), (None, "only without id"), (None, None),
        (4, None), (5, ""), (6, long), (7, long), (8, long + "!"), (9, "\n\n \t"), (10, "x"), (10, "x"), (10, "another text of ten"),
        (11, "é́ 中文 🙂 \u0000 zero"), (12, "no end" * 3000), (-3, "negative"),
    ]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))
