"""Allocation, commissions, payouts and public totals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.money import RATES, allocation, amount_text, money, share, too_large, valid_amount
from tallyloom.functions.text import browser_trim
from tallyloom.operators.numbering import with_previous
from tallyloom.schemas import CONTRIBUTION, PAYMENTS, PAYOUT_STATES
from tallyloom.sources.published import Attempt


def with_allocation(df: DataFrame, amount: str) -> DataFrame:
    return df.withColumns(allocation(F.col(amount)))


def commissions(df: DataFrame, amount: str, attribution: str, received: str, verified: str) -> DataFrame:
    """Commission on received money only: the direct share with a promoter, the secondary
    share for a verified secondary promoter. What nobody earned stays in ``unallocated``."""
    a, who = F.col(amount), F.coalesce(F.col(attribution), F.lit("none"))
    zero = F.lit(0).cast("decimal(18,2)")
    got = F.coalesce(F.col(received), F.lit(False))
    direct = F.when(got & who.isin("direct promoter", "secondary promoter"), share(a, "direct")).otherwise(zero)
    second = F.when(got & (who == "secondary promoter") & F.coalesce(F.col(verified), F.lit(False)), share(a, "secondary")).otherwise(zero)
    due = F.when(got, share(a, "direct") + share(a, "secondary")).otherwise(zero)
    return df.withColumns({"direct_commission": direct, "secondary_commission": second, "unallocated": (due - direct - second).cast("decimal(18,2)")})


def totals(df: DataFrame, category: str, amount: str) -> DataFrame:
    """Money in and its allocation per category (partial sums before the shuffle). Amounts that do not fit are counted in
    ``n_rejected`` and left out of the sums."""
    return with_allocation(df, amount).groupBy(category).agg(*_sums(amount))


def _sums(amount: str) -> list[Column]:
    return [F.sum(money(F.col(amount))).alias("money_in"), *[F.sum(c).alias(c) for c in (*RATES, "programme")], F.count("*").alias("n"), F.count_if("rejected").alias("n_rejected")]


def totals_by_level(df: DataFrame, amount: str, *levels: str) -> DataFrame:
    """Totals of each combination of ``levels`` (for example category, month and payment path), of each of their leading parts, and of
    everything, from one shuffle. ``level``: how many of the columns a row is about; the others are null there, which a null
    value of the data is not."""
    split = with_allocation(df, amount)
    sets = [list(levels[:n]) for n in range(len(levels), -1, -1)]
    depth = F.lit(len(levels)) - F.bit_count(F.grouping_id())
    return split.groupingSets(sets, *levels).agg(depth.cast("int").alias("level"), *_sums(amount))


#: Which state may follow which. The rules name the states, demand that a payout is recorded before it is paid, and leave the rest open; this is
#: our reading: recorded as pending, paid only when approved, held and disputed payouts go back to be approved, reversed is the end.
NEXT_STATES = {
    None: ("pending",),
    "pending": ("approved", "held", "disputed"),
    "approved": ("paid", "held", "disputed"),
    "held": ("pending", "approved", "reversed", "disputed"),
    "disputed": ("pending", "approved", "held", "reversed"),
    "paid": ("disputed", "reversed"),
    "reversed": (),
}


def payout_violations(events: DataFrame, payout: str, ts: str, tiebreak: str, state: str) -> DataFrame:
    """(payout, ts, tiebreak, from_state, to_state, rule): the events that break a rule, each with the first that applies:
    ``unknown_state``, ``not_recorded`` (a payout's first event is not its recording), ``paid_unapproved``, ``not_allowed``.

    An event is held against the one before it in (ts, tiebreak), whether that was allowed or not. Payouts of any number of events: see ``numbering``."""
    ordered = with_previous(events.select(payout, ts, tiebreak, state), [payout], [ts, tiebreak], F.col(state), "from_state")
    now, was = F.col(state), F.col("from_state")
    first = was.isNull()
    fine = first & (now == NEXT_STATES[None][0])
    for a, following in NEXT_STATES.items():
        if a is not None and following:
            fine = fine | ((was == a) & now.isin(*following))
    rule = (
        F.when(now.isNull() | ~now.isin(*PAYOUT_STATES), "unknown_state")
        .when(first & (now != "pending"), "not_recorded")
        .when((now == "paid") & (was != "approved"), "paid_unapproved")
        .when(~F.coalesce(fine, F.lit(False)), "not_allowed")
    )
    return ordered.withColumn("rule", rule).filter("rule IS NOT NULL").select(payout, ts, tiebreak, "from_state", F.col(state).alias("to_state"), "rule")


def payouts_by_month(df: DataFrame, day: str, state: str, amount: str) -> DataFrame:
    """Recorded payouts per month and state; no minimum is defined, so none is applied."""
    month = F.date_format(F.col(day), "yyyy-MM").alias("month")
    return df.groupBy(month, state).agg(F.sum(money(F.col(amount))).alias("amount"), F.count("*").alias("n"))


def methods_active(df: DataFrame, amount: str) -> DataFrame:
    return df.withColumn("methods_active", F.coalesce(F.col(amount) > 0, F.lit(False)))


def _paid(payments: DataFrame) -> DataFrame:
    """Payments of a valid amount that the record can hold."""
    return payments.filter(valid_amount(F.col("amount").cast("double")) & ~too_large(F.col("amount")))


def contributions(payments: DataFrame) -> DataFrame:
    """The contribution record of each valid payment, in the columns of CONTRIBUTION. ``payments`` has received_on, amount,
    payment_path, attribution, verified, service_category, outcome_note, is_public and receipt_status."""
    paid = _paid(payments).withColumn("received", F.lit(True))
    due = commissions(with_allocation(paid, "amount"), "amount", "attribution", "received", "verified")
    named = due.withColumns({"attribution": F.coalesce("attribution", F.lit("none")), "direct": F.col("direct_commission"), "secondary": F.col("secondary_commission"), "is_public": F.coalesce("is_public", F.lit(False))})
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONTRIBUTION])


def after_payment(payments: DataFrame, sender: str = "noreply@example.org", name: str = "Records") -> dict[str, DataFrame]:
    """What follows a payment: ``contributions``, ``ledger`` (the event to append, by payment_id) and ``outbox`` (the mail to
    the payer's ``email``). Payments without a valid amount leave nothing."""
    paid = _paid(payments)
    text = amount_text(F.col("amount"))
    event = F.to_json(F.struct(text.alias("amount"), "payment_path", F.coalesce("attribution", F.lit("none")).alias("attribution")))
    body = F.concat(F.lit("Hello,\n\nThank you. We received your contribution of $"), text, F.lit(f".\n\n{name}\n"))
    return {
        "contributions": contributions(payments),
        "ledger": paid.select(F.col("payment_id").cast("string").alias("asset_id"), F.lit("contribution.recorded").alias("event_type"), event.alias("event_payload"), F.col("received_on").cast("timestamp").alias("created_at")),
        "outbox": paid.select("payment_id", F.col("received_on").cast("timestamp").alias("created_at"), F.col("email").alias("recipient"), F.lit(f"{name}: contribution received").alias("subject"), body.alias("body"), F.lit(f"From: {name} <{sender}>").alias("headers")),
    }


def publish_payments(payments: DataFrame, root: str, batch: str, sender: str = "noreply@example.org", name: str = "Records") -> None:
    """Write the contributions, the ledger's events and the mails of a batch of payments and publish them together; the same batch again
    replaces itself. The payments are written once, and all tables follow from that."""
    attempt = Attempt(payments.sparkSession, root, batch)
    out = after_payment(attempt.put(payments, "payments"), sender, name)
    mails = out["outbox"].withColumn("asset_id", F.col("payment_id").cast("string"))
    for table, df in (out | {"outbox": mails}).items():
        attempt.put(df, table, PAYMENTS[table])
    attempt.commit()


def public_record(records: DataFrame) -> DataFrame:
    """Money in, its allocation and its outcomes per service category, of public contribution records. Null notes and
    blank ones are no outcomes."""
    noted = browser_trim(F.coalesce("outcome_note", F.lit(""))) != ""
    money = [F.sum(c).alias(c) for c in ("operating", "direct", "secondary", "programme")]
    shown = records.filter("is_public").groupBy("service_category")
    return shown.agg(F.sum("amount").alias("money_in"), *money, F.count("*").alias("n"), F.count_if(noted).alias("n_outcomes"))
