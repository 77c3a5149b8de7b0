"""Token counts of whole texts, with a shortcut for pre-tokens that are one token.

A sentencepiece BPE without white-space rewriting merges within a run of blanks and the characters
behind it, because no vocabulary string goes on past the end of such a pre-token; this is checked
against the vocabulary when it is loaded. So a text's count is the sum over its pre-tokens. Which
vocabulary strings encode alone as one token is proved once, with the library itself; a pre-token
among them counts 1 without any merging, and only the rest is merged, each distinct one once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.text import text_slices, whole_text

LIMIT = 4096
BLANK = "▁"
#: Merged pre-tokens a task remembers before it starts afresh.
REMEMBERED = 1_000_000
_PRE_TOKEN = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


@lru_cache(maxsize=2)
def _processor(model_file: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for piece in map(model.id_to_piece, range(model.get_piece_size())):
        if BLANK in piece.lstrip(BLANK):
            raise ValueError(f"vocabulary string {piece!r} spans pre-tokens, so counts per pre-token don't add up")
    if model.encode("  a") == model.encode(" a"):
        raise ValueError("the model drops blanks, so pre-tokens aren't what it sees")
    return model


@lru_cache(maxsize=2)
def single_tokens(model_file: str) -> frozenset[str]:
    """The pre-tokens that encode alone as one token, proved by encoding every vocabulary string."""
    model = _processor(model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    words = [p for p in pieces if p.startswith(BLANK) and _PRE_TOKEN.fullmatch(p)]
    # the library puts one blank in front by itself
    encoded = model.encode([w[1:].replace(BLANK, " ") for w in words], num_threads=1)
    return frozenset(w for w, ids in zip(words, encoded, strict=True) if len(ids) == 1)


class TokenCounter:
    """Counts of one model; made once per task."""

    def __init__(self, model_file: str):
        self.model_file = model_file
        self.model = _processor(model_file)
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all but the single tokens. Keys are pre-tokens without their first blank."""
        self.known = {w[1:]: 1 for w in single_tokens(self.model_file)}
        # the library encodes no text as nothing; a lone blank is seen behind a letter
        self.known[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without their first blank; the library puts one in front of each text."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and BLANK not in text:
            return text.split(" ")
        return [p[1:].replace(BLANK, " ") for p in _PRE_TOKEN.findall(BLANK + text.replace(" ", BLANK))]

    def count(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        if len(self.known) > REMEMBERED:
            self.reset()
        cut = [self.pre_tokens(t) for t in texts]
        rest = list(set(chain.from_iterable(cut)).difference(self.known))
        self.known.update(zip(rest, map(len, self.model.encode(rest, num_threads=1)), strict=True))
        return [sum(map(self.known.__getitem__, words)) for words in cut]


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are the library's, without begin and end marks; strings that look like special tokens are
    text. Null counts as empty; empty texts have no tokens. Repeated rows each give a row, an empty
    table gives none, and other columns of ``docs`` aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(model_file)
        for batch in batches:
            for part in text_slices(batch):
                n = np.array(counter.count(part.column("text").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
