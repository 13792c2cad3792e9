"""Constraint checks: unique keys and references."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys held by several rows, with ``n_rows``."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def reference_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key no parent has."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def linked(ideas: DataFrame, assets: DataFrame) -> DataFrame:
    """Ideas with their asset rows."""
    return ideas.join(assets.select("asset_id", "version", F.col("status").alias("asset_status")), "asset_id")


def ledger_with_ideas(ledger: DataFrame, ideas: DataFrame) -> DataFrame:
    """Every ledger row with its idea's title and source; null where no idea has its asset_id (the link is by
    value and not enforced)."""
    return ledger.join(ideas.select("asset_id", F.col("title").alias("idea_title"), F.col("source").alias("idea_source")), "asset_id", "left")


def append_history(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Append to a table of the warehouse that is dealt and sorted by its key, so that later batches come to it without moving it. ``buckets``
    is fixed by the first batch; about 1 GB a bucket in the end is a good size."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("append").saveAsTable(table)


def repeated_across(batch: DataFrame, table: str, key: str) -> DataFrame:
    """(key, n_batch, n_history): keys of the batch that it holds several times or that the history holds already. Null keys are none. Only the
    batch's keys are shuffled: the history is read bucket by bucket."""
    mine = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_batch"))
    before = batch.sparkSession.table(table).groupBy(key).agg(F.count("*").alias("n_history"))
    joined = mine.hint("merge").join(before.hint("merge"), key, "left").withColumn("n_history", F.coalesce("n_history", F.lit(0)))
    return joined.filter("n_batch > 1 OR n_history > 0")


def unreferenced_across(batch: DataFrame, table: str, child_key: str, key: str) -> DataFrame:
    """Rows of the batch whose non-null key the history lacks; the history is not shuffled."""
    parents = batch.sparkSession.table(table).select(F.col(key).alias(child_key))
    return batch.filter(F.col(child_key).isNotNull()).hint("merge").join(parents.hint("merge"), child_key, "left_anti")


def with_history(batch: DataFrame, table: str, key: str, *columns: str) -> DataFrame:
    """Rows of the batch with the history's columns, null where it has no such key; the history is not shuffled."""
    parents = batch.sparkSession.table(table).select(key, *columns)
    return batch.hint("merge").join(parents.hint("merge"), key, "left")
