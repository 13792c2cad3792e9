"""Harmonic packing of token sequences (operator 2).

A document's ids are cut into full sequences and a remainder; the remainder is cut into
pieces that each fit a reciprocal-capacity class: class m holds pieces of at most
``capacity // m`` ids, m to a sequence. A piece goes whole into a class when it leaves at
most 1/64 of the slot empty; otherwise the largest slot below it is cut off exactly. Each
worker fills the bins of each class on its own and publishes a bin when it holds m pieces.
Unfilled bins (fewer than m pieces a class and worker, whatever the input's size) move to
a sixteenth of the workers, which go on filling, down to one worker; the few bins left
there are packed first-fit by falling length.

Results: null or empty texts are one id (the end id). Repeated rows are packed once each.
An empty table gives no rows. Extra columns are ignored. A document longer than memory for
one row is not supported by Spark itself; any other length is.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Sink, arrow_schema, materialize, read, rows, text_of
from tallyloom.llm.tokens import encoder, vocabulary

CAPACITY = 2048
END_ID = 1
#: A slot may stay empty to this part (one over it).
SLACK = 64
FAN_IN = 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECE + ", sequence_id long, offset long, m int"


def classes(capacity: int = CAPACITY) -> list[int]:
    """1 to 16, then powers of two up to one id a slot."""
    out = [m for m in range(1, 17) if m <= capacity]
    while out[-1] * 2 <= capacity and out[-1] >= 16:
        out.append(out[-1] * 2)
    return out


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a remainder of n ids."""
    slots = [(capacity // m, m) for m in classes(capacity)]
    out = []
    while n:
        above = [(s, m) for s, m in slots if s >= n and (s - n) * SLACK <= s]
        if above:
            s, m = min(above)
            out.append((n, m))
            break
        s, m = next((s, m) for s, m in slots if s <= n)
        out.append((s, m))
        n -= s
    return out


class Bins:
    """Open bins of one worker, one per class."""

    def __init__(self, tag: int, capacity: int):
        self.tag, self.capacity, self.made = tag, capacity, 0
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple], m: int) -> Iterator[tuple]:
        """Place the pieces one after the other in a new sequence."""
        sequence, at = self.tag + self.made, 0
        self.made += 1
        for p in pieces:
            yield (*p, sequence, at, m)
            at += p[2]

    def put(self, piece: tuple, m: int) -> Iterator[tuple]:
        held = self.open.setdefault(m, [])
        held.append(piece)
        if len(held) == m:
            del self.open[m]
            yield from self.close(held, m)

    def rest(self) -> Iterator[tuple]:
        """The pieces of unfilled bins, without a sequence."""
        for m, held in self.open.items():
            for p in held:
                yield (*p, None, None, m)

    def first_fit(self) -> Iterator[tuple]:
        """Pack what is left by falling length into as few sequences as that gives."""
        left = sorted(((p, m) for m, held in self.open.items() for p in held), key=lambda x: (-x[0][2], x[0]))
        room: list[list] = []
        for p, _ in left:
            for b in room:
                if b[0] >= p[2]:
                    b[0] -= p[2]
                    b[1].append(p)
                    break
            else:
                room.append([self.capacity - p[2], [p]])
        for _, pieces in room:
            yield from self.close(pieces, 0)


def _tag(level: int) -> int:
    """Sequence ids of a worker start here: 2**36 sequences a worker, 2**20 workers a level."""
    return (level << 56) + (TaskContext.get().partitionId() << 36)


def _first(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sink, bins = encoder(path), Sink(arrow_schema(PLACED)), Bins(_tag(0), capacity)
        end = np.array([end_id], "<u4").tobytes()
        table = [cuts(n, capacity) for n in range(capacity)]
        for b in batches:
            docs = b.column(0).to_pylist()
            for doc, raw in zip(docs, enc.encode_column(b.column(1)), strict=True):
                raw += end
                n, at = len(raw) // 4, 0
                for length, m in [(capacity, 1)] * (n // capacity) + table[n % capacity]:
                    piece = (doc, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), n)
                    at += length
                    for row in bins.put(piece, m):
                        if sink.add(row):
                            yield from sink.flush()
        for row in bins.rest():
            if sink.add(row):
                yield from sink.flush()
        yield from sink.flush()

    return run


def _next(level: int, last: bool, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, bins = Sink(arrow_schema(PLACED)), Bins(_tag(level), capacity)
        for *piece, _, _, m in rows(batches):
            for row in bins.put(tuple(piece), m):
                if sink.add(row):
                    yield from sink.flush()
        for row in bins.first_fit() if last else bins.rest():
            if sink.add(row):
                yield from sink.flush()
        yield from sink.flush()

    return run


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, m) of all documents.

    One pass over the texts; the pieces are written before they are read twice (placed and
    unfilled), so the texts are tokenized once. Classes keep their own bins, so no key can
    gather rows: a worker's memory is its open bins, fewer than 4,200 pieces.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    step = materialize(slim.mapInArrow(_first(vocabulary_path, capacity, end_id), PLACED), "pieces")
    out = step.filter("sequence_id IS NOT NULL")
    left = step.filter("sequence_id IS NULL")
    workers, level = max(1, step.select(F.input_file_name()).distinct().count()), 0
    while True:
        workers, level = -(-workers // FAN_IN), level + 1
        dealt = left.repartition(workers)  # round robin: no key, so no hot one
        step = materialize(dealt.mapInArrow(_next(level, workers == 1, capacity), PLACED), f"level{level}")
        if workers == 1:
            return out.unionByName(step)
        out, left = out.unionByName(step.filter("sequence_id IS NOT NULL")), step.filter("sequence_id IS NULL")


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
