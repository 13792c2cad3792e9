"""Intake from a stream, and delivery of its mails."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.ingest import Config, publish
from tallyloom.streaming.delivery import deliver, drain, undelivered


def micro_batch_writer(spark: SparkSession, root: str, ts: str, tiebreak: str, config: Config = Config()) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each micro-batch is staged and published under its number, so a batch that is run again after a
    failure replaces itself with the same IDs. Counters go on from the batch before, which is the only one that is read."""

    def write(batch: DataFrame, number: int) -> None:
        publish(batch, ts, tiebreak, root, f"{number:012d}", config)

    return write


__all__ = ["deliver", "drain", "micro_batch_writer", "undelivered"]
