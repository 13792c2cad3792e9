"""Delivery of the outbox: every mail leaves once, however often its row comes.

Mails come from the outbox as a stream. ``drain`` drops copies of a mail that come within the watermark; of what is left, ``deliver``
drops mails that a delivery event shows as sent, however long ago, sends the others and appends an event for each. Events are
appended before the stream commits, so a batch that is run again after a failure finds its own events and sends
nothing twice. What is left open is the time between a mail's sending and the writing of its event, if the job dies just
there: such a mail may leave again, as no database transaction holds a mail server.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schemas import DELIVERIES
from tallyloom.sources.staging import exists


def drain(mails: DataFrame, within: str = "7 days") -> DataFrame:
    """The first row of each asset_id of a stream; state is kept for ``within`` of event time (``created_at``)."""
    return mails.withWatermark("created_at", within).dropDuplicatesWithinWatermark(["asset_id"])


def undelivered(mails: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row for each asset_id that no event shows as delivered. Failed deliveries count as not delivered."""
    done = deliveries.filter("delivered").select("asset_id")
    return mails.dropDuplicates(["asset_id"]).join(done, "asset_id", "left_anti")


def deliver(spark: SparkSession, root: str, send: Callable[[DataFrame], DataFrame], clock: Column | None = None) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``. ``send`` takes mails and returns (asset_id, delivered); it runs once over each mail, on the executors
    (for example ``mapInPandas``)."""

    def write(batch: DataFrame, number: int) -> None:
        mails = undelivered(batch, read_deliveries(spark, root))
        events = send(mails).select("asset_id", F.col("delivered").cast("boolean").alias("delivered"), (F.current_timestamp() if clock is None else clock).alias("created_at"))
        events.write.mode("append").parquet(f"{root}/deliveries")

    return write


def read_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """All delivery events; none where nothing has been delivered yet."""
    path = f"{root}/deliveries"
    return spark.read.schema(DELIVERIES).parquet(path) if exists(spark, path) else spark.createDataFrame([], DELIVERIES)
