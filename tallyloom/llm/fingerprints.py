"""Document fingerprints as invertible Bloom lookup sketches (operator 9).

A text is split into paragraph units: at newlines, after sentence and clause marks, and every
64 characters within what is left, so that short texts have units too. Each unit's XXH64 digest
(with its repeat number, so a repeated line counts each time) is put into one cell of each of
three tables; a cell keeps a count, the XOR of digests and the XOR of check hashes. Subtracting
the sketches of two versions cancels what they share; peeling cells with a single digest left
recovers the rest. If peeling gets stuck, both sketches are built anew at a larger size. Digests that
are equal or collide never peel; after ``GROWTHS`` sizes the digests themselves are subtracted.

likeness = 2 * shared / (units of one + units of the other), 1 for equal sketches.

The printed fingerprint is the sketch at its base size (24 cells), which is a function of the
text alone: equal texts have equal fingerprints.

Plan of the query: one shuffle of the texts by ranges of doc_id, a range a task. A row that begins a range also
goes to the end of the range before it, so each range knows every row's successor. Rows that share a doc_id,
or have none, are of one range.

Results: a null or empty text has no units; two such texts have likeness 1. Rows are ordered by
(doc_id, text), nulls first; repeated rows follow one another. A lone row is its own successor.
An empty table gives no rows. Extra columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Sink, arrow_schema, partitions, read, text_of

BASE = 8
HASHES = 3
UNIT = 64
#: Larger sizes that are tried.
GROWTHS = 4
_EDGES = re.compile(r"\n|(?<=[.!?;:,])\s")
_BLOCKS = re.compile(r".{1,%d}" % UNIT, re.S)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def units(text: str) -> list[str]:
    """Non-blank units of a text."""
    out = []
    for part in _EDGES.split(text):
        part = part.strip()
        if len(part) <= UNIT:
            if part:
                out.append(part)
        else:
            out += _BLOCKS.findall(part)
    return out


def digests(text: str) -> np.ndarray:
    """64-bit digest of each unit; the k-th repeat of a unit has a digest of its own."""
    seen: dict[str, int] = {}
    out = []
    for u in units(text):
        k = seen[u] = seen.get(u, -1) + 1
        out.append(xxhash.xxh64_intdigest(u, k))
    return np.array(out, np.uint64)


def _mix(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * seed
    return x ^ (x >> np.uint64(29))


class Sketch:
    """``HASHES`` tables of ``size`` cells."""

    def __init__(self, keys: np.ndarray, size: int = BASE):
        self.size = size
        cells = HASHES * size
        self.count = np.zeros(cells, np.int64)
        self.keys = np.zeros(cells, np.uint64)
        self.check = np.zeros(cells, np.uint64)
        self._toggle(keys, np.ones(len(keys), np.int64))

    def _cells(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([(_mix(keys, s) >> np.uint64(20)).astype(np.int64) % self.size + i * self.size for i, s in enumerate(_SEEDS)])

    def _toggle(self, keys: np.ndarray, sign: np.ndarray) -> None:
        if not len(keys):
            return
        at = self._cells(keys)
        check = _mix(keys, _CHECK)
        np.add.at(self.count, at, np.concatenate([sign] * HASHES))
        np.bitwise_xor.at(self.keys, at, np.concatenate([keys] * HASHES))
        np.bitwise_xor.at(self.check, at, np.concatenate([check] * HASHES))

    def minus(self, other: "Sketch") -> "Sketch":
        out = Sketch(np.zeros(0, np.uint64), self.size)
        out.count, out.keys, out.check = self.count - other.count, self.keys ^ other.keys, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(digests only in the first, only in the second) of a difference; None when stuck."""
        plus, minus = [], []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[self.check[pure] == _mix(self.keys[pure], _CHECK)]
            if not len(pure):
                break
            keys, first = np.unique(self.keys[pure], return_index=True)
            sign = self.count[pure][first]
            plus.append(keys[sign > 0])
            minus.append(keys[sign < 0])
            self._toggle(keys, -sign)
            if sum(map(len, plus)) + sum(map(len, minus)) > 4 * len(self.count):
                return None
        if self.count.any() or self.keys.any() or self.check.any():
            return None
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *plus]), np.concatenate([none, *minus])

    def text(self) -> str:
        """Counts (16 bits), digests (64) and checks (32) in hexadecimal."""
        return (self.count.astype("<u2").tobytes() + self.keys.astype("<u8").tobytes() + (self.check >> np.uint64(32)).astype("<u4").tobytes()).hex()


def difference(a: np.ndarray, b: np.ndarray, sketch_a: Sketch | None = None, sketch_b: Sketch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in a and only in b, through sketches that grow until peeling succeeds.

    The first try takes the fingerprints themselves. The next size has room for texts without a unit
    in common; it is passed over to at once where the counts of units, which fingerprints hold too,
    differ by more than there are cells. Then sizes grow fourfold, GROWTHS times: what does not peel then
    never will, and the multisets are subtracted as they are."""
    size = BASE
    if abs(len(a) - len(b)) <= HASHES * BASE:
        x = sketch_a if sketch_a is not None else Sketch(a)
        y = sketch_b if sketch_b is not None else Sketch(b)
        found = x.minus(y).peel()
        if found is not None:
            return found
    while 2 * HASHES * size < 3 * (len(a) + len(b)):
        size *= 2
    for _ in range(GROWTHS):
        found = Sketch(a, size).minus(Sketch(b, size)).peel()
        if found is not None:
            return found
        size *= 4
    return _subtracted(a, b)


def _subtracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    more = np.bincount(back[: len(a)], minlength=len(keys)) - np.bincount(back[len(a) :], minlength=len(keys))
    return np.repeat(keys, np.maximum(more, 0)), np.repeat(keys, np.maximum(-more, 0))


def likeness(a: np.ndarray, b: np.ndarray, sketch_a: Sketch | None = None, sketch_b: Sketch | None = None) -> float:
    total = len(a) + len(b)
    if not total:
        return 1.0
    x, y = difference(a, b, sketch_a, sketch_b)
    return 1.0 - (len(x) + len(y)) / total


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the next text's beginning (all of it if shorter)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, doc_id, text) in order; a part's guest is its last row's successor."""
    sink = Sink(arrow_schema(OUT), 2048)
    held = None
    for b in batches:
        for part, guest, doc, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
            d = digests(text)
            now = (part, doc, text, d, Sketch(d))
            if held is not None and held[0] == part:
                _, doc0, t0, d0, s0 = held
                e = edited(t0, text)
                de = digests(e)
                se = Sketch(de)
                row = (doc0, len(t0), hashlib.sha256(e.encode()).hexdigest(), s0.text(), se.text(), likeness(d0, de, s0, se), likeness(d0, d, s0, now[4]))
                if sink.add(row, 1500):
                    yield from sink.flush()
            held = None if guest else now
    yield from sink.flush()


def _ranges(ids: DataFrame, n: int) -> list[int]:
    """Up to n-1 distinct upper bounds (inclusive) that cut the ids into ranges of like count."""
    cut = ids.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first().q or []
    return sorted(set(cut))


def _part_of(bounds: list[int]):
    import pandas as pd

    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        """The range of each id; null ids are in the first one."""
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(edges, ids[known].astype("int64").to_numpy(), "left")
        return pd.Series(out)

    return part


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row and its successor by doc_id."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = max(partitions(slim), 2)
    part = _part_of(_ranges(slim.select("doc_id"), n))
    # a row per range; the first id of each non-empty range is known before any text moves
    firsts = slim.select("doc_id").select(part("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null_first")).orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], OUT)
    guests = [(r.part, firsts[i - 1].part, None if r.null_first else r.low) for i, r in enumerate(firsts)]
    to = spark.createDataFrame(guests, "part int, guest_part int, first_id long")  # as many rows as ranges
    own = slim.select(part("doc_id").alias("part"), "doc_id", "text")
    joined = own.join(F.broadcast(to), "part")
    deal = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("guest_part").alias("part"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")))
    )
    dealt = joined.select(F.explode(deal).alias("to"), "doc_id", "text").select("to.part", "to.guest", "doc_id", "text")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "guest", "doc_id", "text").mapInArrow(_compare, OUT)


def op9_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))
