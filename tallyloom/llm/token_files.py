"""Writing and reading token files in ascending doc_id order (operator 5).

Plan: one range shuffle of the texts by doc_id; a map pass tokenizes each range in order, writes
raw blocks of whole documents and counts ids; the counts of at most ``vocabulary`` ids become
the shared table; a map pass codes each block on its own. A block's
first position is its place in its range plus the totals of earlier ranges, of which there
are as many as partitions. Coded blocks are dealt back to their ranges, so that files in name
order, and blocks in a file, have ascending positions. Reading is a map over blocks.

Results: null or empty texts are the end id alone. Repeated rows and equal doc_ids are kept,
in text order. A null doc_id comes first. An empty table gives an empty file and no rows.
Extra columns are ignored. A text longer than a block makes a block of its own.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import rans
from tallyloom.llm.common import Sink, arrow_schema, materialize, new_path, partitions, read, rows, text_of
from tallyloom.llm.tokens import encoder, vocabulary

BLOCK = 1 << 18
END_ID = 1
RAW = "part int, block int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"
FILE = "part int, block int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _tokenize(path: str, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        sink = Sink(arrow_schema(RAW), 16)
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        docs, lengths, raws, n, first, no = [], [], [], 0, 0, 0
        total = np.zeros(enc.size + 1, np.int64)

        def block_row() -> tuple:
            """The gathered documents; their ids are counted into ``total``."""
            ids = np.frombuffer(b"".join(raws), "<u4").astype(kind)
            total[:] += np.bincount(ids, minlength=len(total))
            return part, no, first, n, docs, lengths, ids.tobytes(), None

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1)), strict=True):
                docs.append(doc)
                lengths.append(len(raw) // 4 + 1)
                raws += [raw, end]
                n += lengths[-1]
                if n >= block:
                    if sink.add(block_row(), 4 * n):
                        yield from sink.flush()
                    first, no = first + n, no + 1
                    docs, lengths, raws, n = [], [], [], 0
        if docs:
            sink.add(block_row())
        if total.any():
            sink.add((part, -1, 0, 0, [], [], None, total.astype("<i8").tobytes()))
        yield from sink.flush()

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) from the counts of each range."""
    for (raw,) in rows(batches):
        total = np.frombuffer(raw, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], schema=arrow_schema("id long, n long"))


def _code(freq: bytes, before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sink = rans.Table.of(np.frombuffer(freq, "<u4")), Sink(arrow_schema(FILE), 16)
        for part, no, first, n, docs, lengths, raw, _ in rows(batches):
            out = rans.encode(_ids(raw, n), table)
            if sink.add((part, no, before[part] + first, n, docs, lengths, out), len(out)):
                yield from sink.flush()
        yield from sink.flush()

    return run


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, block: int = BLOCK) -> None:
    """Write ``path/blocks`` and ``path/table``."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = slim.repartitionByRange(max(partitions(slim), 2), "doc_id").sortWithinPartitions("doc_id", "text")
    raw = materialize(order.mapInArrow(_tokenize(vocabulary_path, end_id, block), RAW), "raw_blocks")
    counts = raw.select("counts").filter("counts IS NOT NULL").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = counts.collect()  # at most a row per vocabulary id
    n = np.zeros(max([r.id for r in got], default=-1) + 1, np.int64)
    for r in got:
        n[r.id] = r.n
    freq = rans.Table.scaled(n).freq.astype("<u4")
    totals = raw.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row per range partition
    before, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        before[r.part], at = at, at + r.n
    coded = raw.filter("block >= 0").mapInArrow(_code(freq.tobytes(), before), FILE)
    sorted_blocks = coded.repartitionById(max(before, default=0) + 1, "part").sortWithinPartitions("block")
    sorted_blocks.write.option("compression", "none").mode("overwrite").parquet(f"{path}/blocks")
    table = [(i, int(f)) for i, f in enumerate(freq.tolist()) if f]
    spark.createDataFrame(table, "id int, freq int").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")


def read_table(spark: SparkSession, path: str) -> bytes:
    """The shared frequencies: at most a row per vocabulary id."""
    got = spark.read.schema("id int, freq int").parquet(f"{path}/table").collect()
    freq = np.zeros(max([r.id for r in got], default=-1) + 1, "<u4")
    for r in got:
        freq[r.id] = r.freq
    return freq.tobytes()


def _digest(freq: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sink = rans.Table.of(np.frombuffer(freq, "<u4")), Sink(arrow_schema(OUT))
        for start, docs, lengths, payload in rows(batches):
            for doc, ids in zip(docs, rans.documents(rans.decode(payload, table), lengths), strict=True):
                if sink.add((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                    yield from sink.flush()
                start += len(ids)
        yield from sink.flush()

    return run


def _decoded(freq: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sink = rans.Table.of(np.frombuffer(freq, "<u4")), Sink(arrow_schema("doc_id long, start long, ids array<long>"), 256)
        for start, docs, lengths, payload in rows(batches):
            for doc, ids in zip(docs, rans.documents(rans.decode(payload, table), lengths), strict=True):
                if sink.add((doc, start, ids.tolist()), 8 * len(ids)):
                    yield from sink.flush()
                start += len(ids)
        yield from sink.flush()

    return run


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "payload")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids, decoded."""
    return blocks(spark, path).mapInArrow(_decoded(read_table(spark, path)), "doc_id long, start long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded."""
    return blocks(spark, path).mapInArrow(_digest(read_table(spark, path)), OUT)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write(read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_digests(spark, path)
