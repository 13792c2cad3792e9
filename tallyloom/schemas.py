"""Explicit schemas of the stored tables and intake payloads. Nothing is inferred: tables are cast to them when they are
published and read by them."""

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType(), "m": T.DecimalType(18, 2), "d": T.DateType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


SUBMISSION = _schema("title:s email:s source:s description:s")
ASSET_SEQUENCES = _schema("sequence_date:s last_number:i updated_at:t")
IDEAS = _schema("asset_id:s title:s originator_email:s source:s description:s status:s created_at:t")
ASSETS = _schema("asset_id:s version:s status:s created_at:t")
LEDGER = _schema("asset_id:s event_type:s event_payload:s created_at:t")
AUDIT_LOG = _schema("actor_email:s action:s payload:s created_at:t")
OUTBOX = _schema("asset_id:s recipient:s subject:s body:s headers:s created_at:t")
REJECTS = _schema("title:s email:s source:s description:s status_code:i created_at:t submitted:s")
DELIVERIES = _schema("asset_id:s delivered:b created_at:t")
CONTRIBUTION = _schema("received_on:d amount:m payment_path:s attribution:s operating:m direct:m secondary:m programme:m service_category:s outcome_note:s is_public:b receipt_status:s")

#: The tables of an intake batch, and of a batch of payments.
INTAKE = {"ideas": IDEAS, "assets": ASSETS, "ledger": LEDGER, "audit_log": AUDIT_LOG, "outbox": OUTBOX, "rejects": REJECTS, "asset_sequences": ASSET_SEQUENCES}
PAYMENTS = {"contributions": CONTRIBUTION, "ledger": LEDGER, "outbox": OUTBOX}

#: Enumerations of the data model.
PAYOUT_STATES = ("pending", "approved", "paid", "held", "reversed", "disputed")
LIFECYCLE = ("Idea", "Lock", "Asset", "Relationships", "Versions", "Implementation", "History")
