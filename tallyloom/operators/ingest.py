"""Fan-out of accepted submissions to the four tables, the outbox and the rejects.

Publishing is staged: a batch is cleaned and validated once and numbered once, both written; every
table is derived from what was written, so all of them agree. A batch becomes visible, or is replaced, all at once (see
``published``). A failed batch leaves a gap in the IDs and no rows, as the two-transaction original does.

The counters after a batch are a table of that batch: one row a day, whatever the number of batches. A batch is numbered from the
counters of the batch before it, which its manifest names for good, so a batch that is run again gets the same IDs, and the
work for a batch does not grow with the batches before it.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.sequence import PREFIX, assign_ids, next_state
from tallyloom.operators.validate import clean_submission, status_code
from tallyloom.schemas import ASSET_SEQUENCES, INTAKE
from tallyloom.sources.published import Attempt, head, published, read_batch
from tallyloom.sources.staging import materialize


@dataclass(frozen=True)
class Config:
    """Deployment settings; every field has a neutral default."""

    prefix: str = PREFIX
    mail_from: str = "noreply@example.org"
    mail_name: str = "Records"
    admin_email: str | None = None


def ideas(df: DataFrame) -> DataFrame:
    return df.select("asset_id", "title", F.col("email").alias("originator_email"), "source", "description", F.lit("draft").alias("status"), "created_at")


def assets(df: DataFrame) -> DataFrame:
    return df.select("asset_id", F.lit("0.1").alias("version"), F.lit("draft").alias("status"), "created_at")


def ledger(df: DataFrame) -> DataFrame:
    return df.select("asset_id", F.lit("idea.locked").alias("event_type"), F.to_json(F.struct("title", "source")).alias("event_payload"), "created_at")


def audit_log(df: DataFrame) -> DataFrame:
    return df.select(F.col("email").alias("actor_email"), F.lit("idea.submit").alias("action"), F.to_json(F.struct("asset_id")).alias("payload"), "created_at")


def outbox(df: DataFrame, config: Config) -> DataFrame:
    """Acknowledgement mails as rows; delivery happens outside. The mail's wording."""
    name, sender = config.mail_name, config.mail_from
    return df.select(
        "asset_id",
        F.col("email").alias("recipient"),
        F.concat(F.lit(f"{name} Asset ID: "), "asset_id").alias("subject"),
        F.concat(F.lit(f"Hello,\n\nYour idea has been received by {name}.\n\nAsset ID: "), "asset_id", F.lit("\nIdea Title: "), "title", F.lit(f"\n\nThis acknowledgement confirms receipt and timestamping of your submission.\n\n{name}\n")).alias("body"),
        F.lit("\r\n".join([f"From: {name} <{sender}>", f"Reply-To: {config.admin_email or sender}", "Content-Type: text/plain; charset=UTF-8"])).alias("headers"),
        "created_at",
    )


def replies(numbered: DataFrame, deliveries: DataFrame | None = None) -> DataFrame:
    """The server's answer to each accepted submission. ``mail_sent`` is whether a delivery event says so; without events no mail has left yet."""
    sent = F.lit(False)
    if deliveries is not None:
        done = deliveries.groupBy("asset_id").agg(F.max("delivered").alias("__sent"))
        numbered, sent = numbered.join(done, "asset_id", "left"), F.coalesce("__sent", F.lit(False))
    return numbered.select("asset_id", F.to_json(F.struct(F.lit(True).alias("ok"), "asset_id", sent.alias("mail_sent"))).alias("reply"))


def fan_out(numbered: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """The tables that are one row a numbered submission."""
    return {"ideas": ideas(numbered), "assets": assets(numbered), "ledger": ledger(numbered), "audit_log": audit_log(numbered), "outbox": outbox(numbered, config)}


def _timed(df: DataFrame, ts: str, clock: Column | None) -> DataFrame:
    """The row's time is ``clock``, now by default, where it brings none."""
    return df.withColumn(ts, F.coalesce(F.col(ts), F.current_timestamp() if clock is None else clock)) if ts in df.columns else df.withColumn(ts, F.current_timestamp() if clock is None else clock)


def _numbered(good: DataFrame, ts: str, tiebreak: str, state: DataFrame | None, config: Config) -> DataFrame:
    return assign_ids(good, ts, tiebreak, state, config.prefix).withColumn("created_at", F.col(ts))


def ingest(submissions: DataFrame, ts: str, tiebreak: str, state: DataFrame | None = None, config: Config = Config(), clock: Column | None = None) -> dict[str, DataFrame]:
    """Clean, validate, number and fan out one batch; the coded and the numbered rows are written on the way. Keys: those of INTAKE, and ``replies``. Rejects keep
    all columns. ``publish`` does it in steps that become visible at once.

    Coded rows are written before they are split: a filter on the code, moved below the cleaning, would clean a field anew at each place
    where the code's rules name it, and dealing by ranges would do all that twice."""
    cleaned = clean_submission(_timed(submissions, ts, clock))
    coded = materialize(cleaned.withColumn("status_code", status_code(cleaned)), "coded")
    good, bad = coded.filter("status_code = 200"), coded.filter("status_code <> 200")
    numbered = _numbered(good, ts, tiebreak, state, config)
    return fan_out(numbered, config) | {"replies": replies(numbered), "rejects": bad, "asset_sequences": next_state(numbered, ts, state)}


def publish(submissions: DataFrame, ts: str, tiebreak: str, root: str, batch: str, config: Config = Config(), clock: Column | None = None) -> None:
    """Write the tables of INTAKE and publish them. Writing the same batch again replaces it; rows without a time keep the one they got
    from the first publishing.

    Raises ValueError where a batch that others follow would leave other counters than it did, as these have been numbered from them."""
    spark = submissions.sparkSession
    attempt = Attempt(spark, root, batch)
    state = attempt.previous and read_batch(spark, root, "asset_sequences", attempt.previous, ASSET_SEQUENCES)
    cleaned = clean_submission(_timed(submissions, ts, F.lit(attempt.clock).cast("timestamp") if clock is None else clock))
    coded = attempt.put(cleaned.withColumn("status_code", status_code(cleaned)), "coded")
    good, bad = coded.filter("status_code = 200"), coded.filter("status_code <> 200")
    numbered = attempt.put(_numbered(good, ts, tiebreak, state, config), "numbered")
    bad = bad.withColumns({"created_at": F.col(ts), "submitted": F.to_json(F.struct("*"))})
    counters = next_state(numbered, ts, state).withColumn("updated_at", F.current_timestamp())
    for name, df in (fan_out(numbered, config) | {"rejects": bad, "asset_sequences": counters}).items():
        written = attempt.put(df, name, INTAKE[name])
        if name == "asset_sequences" and attempt.before and head(spark, root) != batch:
            was = read_batch(spark, root, name, batch, ASSET_SEQUENCES).select("sequence_date", "last_number")
            now = written.select("sequence_date", "last_number")
            if not (now.exceptAll(was).isEmpty() and was.exceptAll(now).isEmpty()):
                raise ValueError(f"batch {batch} is followed by others and would change the IDs' counters")
    attempt.commit()


def state_before(spark: SparkSession, root: str, batch: str) -> DataFrame | None:
    """(sequence_date, last_number, updated_at) as the batch before left it; None for the first batch."""
    found = published(spark, root, batch)
    previous = found["previous"] if found else head(spark, root, batch)
    return previous and read_batch(spark, root, "asset_sequences", previous, ASSET_SEQUENCES)
