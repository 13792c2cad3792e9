"""Search of records by an index of three-character terms, which finds what ``records.search`` finds.

A row of the index is a term and the key of a record that has it in one of its columns, in lower case. The index is a folder of Parquet
files by bucket of the term's hash, sorted by term, to which every batch of records is appended. A search reads the buckets of
its own terms, in these only the row groups that may hold them, keeps keys that have all terms, and then looks at the
records that are left. A frequent term has as many files as its keys fill: keys are dealt by ranges of (bucket, term, key).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.records import search
from tallyloom.sources.staging import partitions

TERM = 3
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def _terms(text: Column) -> Column:
    """Distinct terms of a text in lower case; none for shorter texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.length(low) - TERM + 1
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(TERM)))).otherwise(F.array().cast("array<string>")))


def append_index(df: DataFrame, key: str, root: str, *cols: str) -> None:
    """Index a batch of records. ``key`` names a record for good; a record that changes is indexed again under a new key."""
    terms = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.array(*[_terms(F.col(c)) for c in cols])))).alias("term"))
    dealt = terms.withColumn("bucket", _bucket(F.col("term"))).repartitionByRange(partitions(df), "bucket", "term", "key").sortWithinPartitions("bucket", "term", "key")
    dealt.write.mode("append").partitionBy("bucket").parquet(root)


def matching_keys(spark: SparkSession, root: str, text: str, key_type: str) -> DataFrame:
    """(key): records that have all terms of the text, each in one column or another: a superset of the matches."""
    low = text.lower()
    wanted = sorted({low[i : i + TERM] for i in range(len(low) - TERM + 1)})
    index = spark.read.schema(f"key {key_type}, term string, bucket int").parquet(root)
    buckets = spark.range(1).select(*[_bucket(F.lit(t)).alias(f"b{i}") for i, t in enumerate(wanted)]).first()
    rows = index.filter(F.col("bucket").isin(*set(buckets)) & F.col("term").isin(*wanted))
    return rows.groupBy("key").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(wanted)).select("key")


def search_indexed(df: DataFrame, key: str, root: str, text: str, *cols: str) -> DataFrame:
    """The rows that ``search`` gives. A text of fewer than three characters has no term, so all records are looked at."""
    if len(text) < TERM:
        return search(df, text, *cols)
    found = matching_keys(df.sparkSession, root, text, df.schema[key].dataType.simpleString())
    return search(df.join(found.withColumnRenamed("key", key), key, "left_semi").select(*df.columns), text, *cols)
