"""Token ids as compressed binary files.

Documents are tokenised once; ids are counted over all of them into one shared frequency table, dealt
out in ascending order of ids to files of about equal size, and coded block by block (``rans``).
A file is a Parquet file of blocks, written and committed by Spark on whatever store the folder is on,
so a lost executor repeats its own files only. Each block carries its documents' ids and lengths, where
it begins in its file, and its coded ids; ``table`` beside the blocks holds the frequencies.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom.llm import rans
from stationloom.llm.text import text_slices, whole_text
from stationloom.session import scratch_path

END_ID = 1
#: Ids of a block, about; a longer document makes a longer block.
BLOCK_IDS = 1 << 18
#: Ids of a file, about: at most the first unless there would be more than FILES, then at most the second.
FILE_IDS, LARGE_FILE_IDS, FILES = 8 << 20, 256 << 20, 10_000
#: Pieces between blanks that a task remembers before it starts afresh.
REMEMBERED = 1_200_000
_BLANKS = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
_BLANKS_AND_CASE = bytes(32 if b in b"\t\n\r\x0b\x0c" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Pieces of printable ASCII without capitals, apostrophes and the sign that special tokens begin with, and their pre-tokens.
_PLAIN, _PRE_TOKENS = re.compile(rb"[!-&(-;=-@\[-~]+"), re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_SIGNS, _ALNUM = b".,;:!?*&%$#|()", b"abcdefghijklmnopqrstuvwxyz0123456789"


@lru_cache(maxsize=2)
def _tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers.Tokenizer.from_file(file)


class Encoder:
    """Ids of texts as little-endian bytes; a Python worker keeps it over its tasks.

    The tokenizer drops white space, lower-cases, and no token spans white space, so a text's ids are those of
    its lower-cased pieces between blanks, and each distinct piece is encoded once. A run of signs behind a
    letter or digit is a pre-token of its own, so a piece that ends with one is put together from two.
    ``splits_at_blanks`` tests all this for a tokenizer. Texts with a special token's first signs stay in their case.
    Plain pieces need no normalising, and the tokenizer's model is asked for their pre-tokens alone, where ``cuts_plainly`` holds.
    """

    def __init__(self, file: str):
        if not splits_at_blanks(file):
            raise ValueError("this tokenizer doesn't treat blanks, case and signs as this encoder needs")
        self.tokenizer = _tokenizer(file)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {b"": b""}
        self.plain = cuts_plainly(file)

    def _learn_plain(self, pieces: list[bytes]) -> None:
        known, model, kind = self.known, self.tokenizer.model, "H" if self.kind == "<u2" else "I"
        cut = [_PRE_TOKENS.findall(p) for p in pieces]
        for p in set(chain.from_iterable(cut)).difference(known):
            ids = [t.id for t in model.tokenize(p.decode())]
            known[p] = struct.pack(f"<{len(ids)}{kind}", *ids)
        for p, parts in zip(pieces, cut, strict=True):
            if len(parts) > 1:
                known[p] = b"".join(map(known.__getitem__, parts))

    def _learn(self, pieces: list[bytes]) -> None:
        encoded = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        ids = [e.ids for e in encoded]
        flat = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
        width, at = np.dtype(self.kind).itemsize, 0
        for p, own in zip(pieces, ids, strict=True):
            end = at + width * len(own)
            self.known[p] = flat[at:end]
            at = end

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {b"": b""}
        known = self.known
        cut = [t.translate(_BLANKS if b"<|" in t else _BLANKS_AND_CASE).split(b" ") for t in texts]
        rest = set(chain.from_iterable(cut)).difference(known)
        if self.plain:
            plain = [p for p in rest if _PLAIN.fullmatch(p)]
            self._learn_plain(plain)
            rest.difference_update(plain)
        stems = {p: stem for p in rest if (stem := p.rstrip(_SIGNS)) != p and stem and stem[-1:] in _ALNUM}
        new = (rest.difference(stems) | set(stems.values()) | {p[len(stem):] for p, stem in stems.items()}).difference(known)
        new = list(new)
        for a in range(0, len(new), 20_000):
            self._learn(new[a : a + 20_000])
        for p, stem in stems.items():
            known[p] = known[stem] + known[p[len(stem):]]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]


@lru_cache(maxsize=2)
def splits_at_blanks(file: str) -> bool:
    """Whether white space is dropped and separates, case doesn't matter, and signs behind letters and digits stand
    alone, on texts that join letters, marks, digits and signs."""
    t = _tokenizer(file)
    kinds = ["a", "Zb", "é", "e", "́", "7", "12", "'s", "'", ".", "!?", "中", "İ", "\U0001f642", "<|endoftext|>", "|>", "Σ", "σΣ", "​"]

    def ids(text: str) -> list[int]:
        return t.encode(text, add_special_tokens=False).ids

    blanks = all(ids(f"{a}{blank}{b}") == ids(a) + ids(b) for a in kinds for b in kinds for blank in (" ", "\n", "\t ", "\r\n", "\x0b", "\x0c"))
    stems = ["a", "it's", "é7", "don't", "x.y", "a'd", "中z", "12", "abc9"]
    signs = all(ids(a + b) == ids(a) + ids(b) for a in stems for b in (".", ",***", "!?|", "%)", "&&&", "((#$;:"))
    case = all(ids(x) == ids("".join(c.lower() if c.isascii() else c for c in x)) for x in ("AbC", "I'LL", "I\u0307X", "A\u030a", "ÀB", "ΣAΣ", "İI"))
    return blanks and signs and case


@lru_cache(maxsize=2)
def cuts_plainly(file: str) -> bool:
    """Whether a plain piece's ids are those that the model gives for its runs of letters, single digits and runs of signs."""
    t = _tokenizer(file)
    signs = bytes(b for b in range(33, 127) if _PLAIN.fullmatch(bytes([b])) and not bytes([b]).isalnum()).decode()
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = ["a", "it", "the", "s", "re", "ll", "d", "7", "12", "2024", ".", "...", "!?", "|>", "``", "--", "_", "http://", *signs]
    pieces = [letters, digits, signs, *signs, *letters, *digits, *(a + b for a in kinds for b in kinds), *(a + b + a for a in letters for b in signs)]
    pieces += [a + b for a in letters + digits for b in letters + digits]
    whole = t.encode_batch_fast(pieces, add_special_tokens=False)
    return all([x.id for part in _PRE_TOKENS.findall(p.encode()) for x in t.model.tokenize(part.decode())] == e.ids
               for p, e in zip(pieces, whole, strict=True))


@lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


def _tokenised(docs: DataFrame, file: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for part in text_slices(batch):
                ids = [b + end for b in encoder.encode(part.column("text").cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def _counted(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0)
            offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            own = np.bincount(np.frombuffer(ids.buffers()[2], kind, (offsets[-1] - offsets[0]) // np.dtype(kind).itemsize, int(offsets[0])))
            if len(own) > len(total):
                total = np.pad(total, (0, len(own) - len(total)))
            total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
                      id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write ``folder/blocks`` and ``folder/table``. Null texts are empty and hold the end id only; repeated
    rows are written each; null ids come first; an empty table gives no block. Other columns aren't read."""
    spark = docs.sparkSession
    tokens = scratch_path(spark, "token-ids")
    _tokenised(docs, tokenizer_file, end_id, id_column, text_column).write.parquet(tokens)
    rows = spark.read.parquet(tokens)
    vocabulary = _tokenizer(tokenizer_file).get_vocab_size()
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    # as many rows as the vocabulary has strings, whatever the corpus
    rows.select("ids").mapInArrow(_counted(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{folder}/table")
    counts = spark.read.parquet(f"{folder}/table")
    total = counts.agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-total // LARGE_FILE_IDS), min(-(-total // FILE_IDS), FILES))
    shared = spark.sparkContext.broadcast(read_table(spark, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, file, begun, block = shared.value, TaskContext.get().partitionId(), 0, 0
        held_docs, held_ids, held = [], [], 0

        def out() -> pa.RecordBatch:
            lengths = [len(x) for x in held_ids]
            coded = rans.encode(np.concatenate(held_ids), table)
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([begun], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([held_docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([coded], pa.binary())],
                ["file", "block", "begins", "n_ids", "doc_ids", "lengths", "coded"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), kind)
                if held and held + len(ids) > block_ids:
                    yield out()
                    begun, block, held_docs, held_ids, held = begun + held, block + 1, [], [], 0
                held_docs.append(doc)
                held_ids.append(ids)
                held += len(ids)
        if held:
            yield out()

    # ties of one id are spread by where they lie in the written table
    placed = rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(int(files), F.col("doc_id").asc_nulls_first(), "_at").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_at")
    placed.drop("_at").mapInArrow(run, "file int, block int, begins long, n_ids long, doc_ids array<long>, lengths array<long>, coded binary").write.parquet(f"{folder}/blocks")


def read_table(spark: SparkSession, folder: str) -> rans.FrequencyTable:
    """The shared frequency table of a folder."""
    rows = spark.read.parquet(f"{folder}/table").collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return rans.FrequencyTable.from_counts(counts)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: ``doc_id, start, ids`` (little-endian 32-bit), decoded and verified block by block."""
    shared = spark.sparkContext.broadcast(read_table(spark, folder))
    blocks = spark.read.parquet(f"{folder}/blocks")
    # as many rows as there are files
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    files = files.select("file", F.expr("sum(n) over (order by file) - n").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = rans.decode(batch.column("coded")[k].as_py(), shared.value)
                lengths = np.array(batch.column("lengths")[k].as_py(), np.int64)
                ends = np.cumsum(lengths)
                if ends[-1] != len(ids):
                    raise ValueError("lengths and ids of a block differ")
                start = batch.column("before")[k].as_py() + batch.column("begins")[k].as_py() + ends - lengths
                ids = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("doc_ids")[k].as_py(), pa.int64()), pa.array(start),
                     pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"])

    columns = ["begins", "doc_ids", "lengths", "coded", "before"]
    return blocks.join(F.broadcast(files), "file").select(*columns).mapInArrow(run, "doc_id long, start long, ids binary")


def token_digest(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_token_files`` returns."""
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
