"""Shared helpers: written intermediate tables (see ``staging``), Arrow row streams."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.staging import clean, materialize, new_path, own_dir, partitions, shared_dir

__all__ = ["SPACE", "WORD", "Sink", "arrow_schema", "clean", "materialize", "new_path", "own_dir", "partitions", "read", "rows", "shared_dir", "text_of"]

#: Words are maximal runs of characters other than these six white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, '' where null."""
    return F.coalesce(F.col(column), F.lit(""))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


class Sink:
    """Gathers rows into Arrow batches of a schema, cut at ``limit`` rows or about ``size`` bytes."""

    def __init__(self, schema: pa.Schema, limit: int = 4096, size: int = 4 << 20):
        self.schema, self.limit, self.size = schema, limit, size
        self.clear()

    def clear(self) -> None:
        self.cols: list[list] = [[] for _ in self.schema]
        self.n = self.bytes = 0

    def add(self, row: tuple, weight: int = 0) -> bool:
        """True when it is time to flush."""
        for c, v in zip(self.cols, row, strict=True):
            c.append(v)
        self.n += 1
        self.bytes += weight
        return self.n >= self.limit or self.bytes >= self.size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema, strict=True)], schema=self.schema)
            self.clear()
            yield out


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL of flat columns: ``a long, b string, c binary, d double, e int, f boolean``."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in ddl.split(","))])

