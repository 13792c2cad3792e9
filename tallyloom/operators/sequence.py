"""Per-day sequential asset IDs without a task that holds a day, or a second.

Rows are numbered by ranges of (day, time, tiebreak); see ``numbering``. All rows of a bulk load may have one timestamp.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.numbering import number_rows

#: Fixed value: the configured default prefix.
PREFIX = "IPM"


def format_id(day: Column, number: Column, prefix: str = PREFIX) -> Column:
    """``PREFIX-yyyymmdd-NNNNNN``: padded to six digits, never cut. Null without a day or number."""
    return F.when(day.isNotNull() & number.isNotNull(), F.format_string("%s-%s-%06d", F.lit(prefix), day, number))


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def assign_ids(df: DataFrame, ts: str, tiebreak: str, state: DataFrame | None = None, prefix: str = PREFIX) -> DataFrame:
    """Adds ``sequence_date``, ``sequence_number`` (long) and ``asset_id`` in order of (ts, tiebreak) per UTC day.

    ``state`` has (sequence_date, last_number); days it lacks start at 1. Rows with a
    null timestamp get a null ID. One writer at a time, as there is no row lock. The rows are
    written once on the way, so later steps do not repeat what made them.
    """
    numbered = number_rows(df.withColumn("sequence_date", utc_day(F.col(ts))), ["sequence_date"], [ts, tiebreak], "sequence_number")
    last = F.lit(0)
    if state is not None:
        numbered = numbered.join(state.select("sequence_date", F.col("last_number").cast("long").alias("__last")), "sequence_date", "left")
        last = F.coalesce("__last", F.lit(0))
    number = F.when(F.col("sequence_date").isNotNull(), F.col("sequence_number") + 1 + last)
    out = numbered.withColumn("sequence_number", number).withColumn("asset_id", format_id(F.col("sequence_date"), F.col("sequence_number"), prefix))
    return out.select(*[c for c in df.columns if c not in ("sequence_date", "sequence_number", "asset_id")], "sequence_date", "sequence_number", "asset_id")


def next_state(df: DataFrame, ts: str, state: DataFrame | None = None) -> DataFrame:
    """(sequence_date, last_number) after the batch; earlier days are kept."""
    new = df.filter(F.col(ts).isNotNull()).groupBy(utc_day(F.col(ts)).alias("sequence_date")).agg(F.count("*").alias("n"))
    if state is not None:
        new = new.unionByName(state.select("sequence_date", F.col("last_number").cast("long").alias("n")))
    return new.groupBy("sequence_date").agg(F.sum("n").cast("int").alias("last_number"))
