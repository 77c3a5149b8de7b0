"""A static range asymmetric numeral system over token ids.

All blocks share one table of frequencies. A block deals its ids out to lanes that are coded side by
side into one stream of 32-bit words, holds checkpoints from which decoding can start, and ends with
a checksum. Blocks don't depend on each other, so any number of them can be decoded at once.

Layout of a block, little-endian: magic ``SLR1``, checksum of the table, lanes, number of ids, steps
between checkpoints, number of words (each 32 bits); per checkpoint the place in the stream (32 bits)
and the state of each lane (64 bits); the words; crc32 of all before.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Frequencies add up to 2^PRECISION. States stay within [LOW, LOW * 2^32).
PRECISION, LOW = 20, 1 << 31
LANES, CHECKPOINT_STEPS = 1024, 128
_HEAD = struct.Struct("<4sIIIII")
_MAGIC = b"SLR1"


@dataclass
class FrequencyTable:
    """Frequencies of all ids, at least 1 for each that occurs, 2^PRECISION in all."""

    frequency: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> FrequencyTable:
        """Scale counts; ids that don't occur get none and can't be coded."""
        counts = np.asarray(counts, np.int64)
        seen = np.flatnonzero(counts)
        if len(seen) > 1 << PRECISION:
            raise ValueError(f"{len(seen)} distinct ids don't fit into 2^{PRECISION} slots")
        out = np.zeros(len(counts), np.int64)
        if not len(seen):
            return cls(out)
        spare = (1 << PRECISION) - len(seen)
        exact = counts[seen] / counts.sum() * spare
        share = np.floor(exact).astype(np.int64)
        missing = spare - int(share.sum())
        share[np.argsort(share - exact, kind="stable")[:missing]] += 1
        out[seen] = share + 1
        return cls(out)

    @cached_property
    def start(self) -> np.ndarray:
        return np.cumsum(self.frequency) - self.frequency

    @cached_property
    def by_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency)

    @cached_property
    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        return self.frequency.astype(np.uint64), self.start.astype(np.uint64)

    @cached_property
    def checksum(self) -> int:
        return zlib.crc32(self.frequency.astype("<u4").tobytes())


_WORD, _BITS, _LOW = np.uint64(32), np.uint64(PRECISION), np.uint64(LOW)
_MASK, _SLOT = np.uint64(0xFFFFFFFF), np.uint64((1 << PRECISION) - 1)
_ROOM = np.uint64((LOW >> PRECISION) << 32)


def encode(ids: np.ndarray, table: FrequencyTable, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """One block."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    frequency, start = table.wide
    f_all, s_all = frequency[ids], start[ids]
    if n and not f_all.all():
        raise ValueError("an id that the table doesn't know")
    states = np.full(lanes, _LOW, np.uint64)
    words, counts = [], np.zeros(steps + 1, np.int64)
    checkpoints = {}
    for t in range(steps - 1, -1, -1):
        f, s = f_all[t * lanes : (t + 1) * lanes], s_all[t * lanes : (t + 1) * lanes]
        x = states[: len(f)]
        full = x >= _ROOM * f
        words.append((x[full] & _MASK).astype("<u4"))
        counts[t] = len(words[-1])
        x = np.where(full, x >> _WORD, x)
        quotient = x // f
        states[: len(f)] = (quotient << _BITS) + (x - quotient * f) + s
        if t % every == 0:
            checkpoints[t] = states.copy()
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    place = np.cumsum(counts) - counts
    out = [_HEAD.pack(_MAGIC, table.checksum, lanes, n, every, len(stream))]
    for t in sorted(checkpoints):
        out += [struct.pack("<I", place[t]), checkpoints[t].astype("<u8").tobytes()]
    out.append(stream.tobytes())
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def checkpoints_of(block: bytes) -> int:
    """How many parts of a block can be decoded on their own."""
    _, _, lanes, n, every, _ = _HEAD.unpack_from(block)
    return -(-(-(-n // lanes)) // every)


def decode(block: bytes, table: FrequencyTable, part: int | None = None) -> np.ndarray:
    """The ids of a block, or those from one checkpoint to the next."""
    magic, checksum, lanes, n, every, n_words = _HEAD.unpack_from(block)
    if magic != _MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("the block is damaged")
    if checksum != table.checksum:
        raise ValueError("the block was coded with another table")
    steps = -(-n // lanes)
    size = 4 + 8 * lanes
    marks = -(-steps // every)
    words = np.frombuffer(block, "<u4", n_words, _HEAD.size + marks * size).astype(np.uint64)
    if not n:
        return np.empty(0, np.uint32)
    first = part or 0
    last = steps if part is None else min(steps, (part + 1) * every)
    at = _HEAD.size + first * size
    (place,) = struct.unpack_from("<I", block, at)
    states = np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)
    frequency, start = table.wide
    by_slot = table.by_slot
    out = np.empty(steps * lanes, np.uint32)
    for t in range(first * every, last):
        width = min(lanes, n - t * lanes)
        x = states[:width]
        slot = x & _SLOT
        ids = by_slot[slot]
        out[t * lanes : t * lanes + width] = ids
        x = frequency[ids] * (x >> _BITS) + slot - start[ids]
        short = np.flatnonzero(x < _LOW)
        if len(short):
            x[short] = (x[short] << _WORD) | words[place : place + len(short)]
            place += len(short)
        states[:width] = x
    if last == steps and not (states == _LOW).all():
        raise ValueError("the block doesn't end as it began")
    return out[first * every * lanes : min(n, last * lanes)]
