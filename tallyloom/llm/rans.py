"""Token files with static range asymmetric numeral coding (operator 5).

Format. A token file is a Parquet dataset with a row a block, so any store that Spark
writes to can hold it and Spark's committer covers lost executors. A block holds whole
documents: their ids and lengths, and one self-contained byte string:

* header: magic ``TLRB``, version, lane count, ids in all, ids between checkpoints,
  CRC-32 of the decoded ids (unsigned little-endian 32-bit) and number of words;
* the lanes' start states, then a checkpoint (word offset and lane states) every
  ``CHECKPOINT`` steps: decoding can begin at any checkpoint;
* the words of the interleaved coders, in decoding order.

Id i of a block belongs to lane ``i % lanes``. All blocks share one frequency table, kept
in its own small dataset beside them (at most one row per vocabulary id). States are 64
bits wide, words 32 bits; frequencies sum to 2**20. A reader decodes blocks independently.
"""

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"TLRB"
LANES = 2048
CHECKPOINT = 64
SCALE = 20
LOW = 1 << 31
HEAD = struct.Struct("<4sHHQIII")


@dataclass
class Table:
    """Scaled frequencies, their running sums, and the symbol of each slot."""

    freq: np.ndarray
    cum: np.ndarray
    symbol: np.ndarray | None = None

    @classmethod
    def scaled(cls, counts: np.ndarray) -> "Table":
        """Every id that occurs gets at least 1 of the 2**SCALE slots."""
        counts = counts.astype(np.float64)
        used, total = np.flatnonzero(counts), 1 << SCALE
        freq = np.zeros(len(counts), np.int64)
        if len(used) > total:
            raise ValueError("more ids than slots")
        if len(used):
            share = counts[used] / counts.sum() * (total - len(used))
            freq[used] = 1 + np.floor(share).astype(np.int64)
            rest = total - int(freq.sum())
            order = np.lexsort((used, -(share - np.floor(share))))[:rest]
            freq[used[order]] += 1
            freq[used[np.argmax(freq[used])]] += total - int(freq.sum())
        return cls.of(freq)

    @classmethod
    def of(cls, freq: np.ndarray) -> "Table":
        freq = freq.astype(np.uint64)
        return cls(freq, np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64) if len(freq) else freq)

    def slots(self) -> np.ndarray:
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self.symbol


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block. ``ids``: unsigned 32-bit."""
    n = len(ids)
    steps = -(-n // LANES)
    states = np.full(LANES, LOW, np.uint64)
    f, c = table.freq[ids], table.cum[ids]
    if n and not f.all():
        raise ValueError("an id has no frequency")
    limit = f << np.uint64(63 - SCALE)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min((t + 1) * LANES, n)
        x, ft = states[: b - a], f[a:b]
        over = x >= limit[a:b]
        words.append(x[over].astype(np.uint32))
        x[over] >>= np.uint64(32)
        q = x // ft
        x[:] = (q << np.uint64(SCALE)) + (x - q * ft) + c[a:b]
        if t and t % CHECKPOINT == 0:
            marks.append(states.copy())
    words.reverse()
    marks.reverse()
    ends = np.cumsum([len(w) for w in words]).astype("<u4") if words else np.zeros(0, "<u4")
    offsets = ends[CHECKPOINT - 1 : steps - 1 : CHECKPOINT][: len(marks)]
    flat = np.concatenate(words).astype("<u4") if words else np.zeros(0, "<u4")
    head = HEAD.pack(MAGIC, 1, LANES, n, CHECKPOINT, zlib.crc32(ids.astype("<u4").tobytes()), len(flat))
    parts = [head, states.astype("<u8").tobytes()]
    for o, m in zip(offsets.tolist(), marks, strict=True):
        parts += [struct.pack("<I", o), m.astype("<u8").tobytes()]
    return b"".join([*parts, flat.tobytes()])


def decode(block: bytes, table: Table, first_mark: int = 0, last_mark: int | None = None) -> np.ndarray:
    """The ids of a block, or of the part between two checkpoints (0: the block's start)."""
    magic, version, lanes, n, every, crc, n_words = HEAD.unpack_from(block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    steps = -(-n // lanes)
    n_marks = max(0, -(-steps // every) - 1)
    size = 8 * lanes
    at = HEAD.size
    if first_mark:
        at += size + (first_mark - 1) * (4 + size)
        pos = struct.unpack_from("<I", block, at)[0]
        at += 4
    else:
        pos = 0
    x = np.frombuffer(block, "<u8", lanes, at).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, HEAD.size + size + n_marks * (4 + size)).astype(np.uint64)
    symbol, freq, cum = table.slots(), table.freq, table.cum
    start = first_mark * every
    stop = steps if last_mark is None or last_mark > n_marks else last_mark * every
    out = np.empty(min(stop * lanes, n) - start * lanes, np.uint32)
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for t in range(start, stop):
        a, b = t * lanes, min((t + 1) * lanes, n)
        v = x[: b - a]
        slot = v & mask
        s = symbol[slot.astype(np.int64)]
        out[a - start * lanes : b - start * lanes] = s
        v[:] = freq[s] * (v >> shift) + slot - cum[s]
        low = np.flatnonzero(v < LOW)
        if len(low):
            v[low] = (v[low] << np.uint64(32)) | words[pos : pos + len(low)]
            pos += len(low)
    if stop == steps and ((x != LOW).any() or pos != n_words):  # coders end where encoding began
        raise ValueError("checksum of a token block does not match: its coders do not end as they began")
    if start == 0 and stop == steps and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a token block does not match")
    return out


def marks(block: bytes) -> int:
    """Number of checkpoints inside a block."""
    _, _, lanes, n, every, _, _ = HEAD.unpack_from(block)
    return max(0, -(-(-(-n // lanes)) // every) - 1)


def documents(ids: np.ndarray, lengths: list[int]) -> Iterator[np.ndarray]:
    at = 0
    for n in lengths:
        yield ids[at : at + n]
        at += n
