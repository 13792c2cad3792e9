"""Queries over the driver's tables. The tables stand in for the stored records: none of
them is a record table, so each query says which column plays which part."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import money, text
from tallyloom.operators import accounting, constraints, graph, ingest, records, sequence, text_index, validate
from tallyloom.schemas import IDEAS, LEDGER, LIFECYCLE
from tallyloom.sources import intake, markdown, published
from tallyloom.sources.staging import materialize, new_path
from tallyloom.sources.tables import read_table
from tallyloom.streaming import undelivered


def recent_records(spark: SparkSession, d: str) -> DataFrame:
    """Newest 25 of ``events``: event type as title and status, user as source."""
    ev = read_table(spark, d, "events")
    ideas = ev.select(F.format_string("%012d", "event_id").alias("asset_id"), F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("source"), F.lit("draft").alias("status"), F.col("ts").alias("created_at"))
    return records.recent_records(ideas)


RECENT_SQL = """SELECT printf('%012d', event_id) AS asset_id, event_type AS title, CAST(user_id AS VARCHAR) AS source, 'draft' AS status, ts AS created_at
FROM events ORDER BY ts DESC, event_id DESC LIMIT 25"""


def response_json(spark: SparkSession, d: str) -> DataFrame:
    return records.as_response(recent_records(spark, d), "asset_id", "title", "source", "status")


RESPONSE_SQL = f"""SELECT '{{"asset_id":"' || asset_id || '","title":"' || title || '","source":"' || source || '","status":"' || status || '"}}' AS json FROM ({RECENT_SQL})"""


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", text.clean(F.col("text"), 120).alias("title"), text.clean(F.col("text"), 3000).alias("description"))


def _clean_sql(c: str, n: int) -> str:
    return rf"substring(regexp_replace(regexp_replace({c}, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g'), '[\s\x0B\x85\p{{Z}}]+', ' ', 'g'), 1, {n})"


CLEAN_SQL = f"SELECT doc_id, {_clean_sql('text', 120)} AS title, {_clean_sql('text', 3000)} AS description FROM documents"


def source_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Event type ``click`` plays the option Other, the props text the custom entry."""
    ev = read_table(spark, d, "events")
    option = F.when(F.col("event_type") == "click", "Other").otherwise(F.col("event_type"))
    return ev.select("event_id", validate.resolve_source(option, F.concat(F.lit(" "), "props")).alias("source"), validate.custom_entry_visible(option, F.lit("x")).alias("shown"))


SOURCE_SQL = "SELECT event_id, CASE WHEN event_type = 'click' THEN trim(props) ELSE event_type END AS source, event_type = 'click' AS shown FROM events"


def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Conversations: the role plays the title (blank for system), an address is built from the key."""
    c = read_table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("role") == "system", "  ").otherwise(F.col("role")).alias("title"), F.format_string("u%d@%s", "conv_id", F.when(F.col("conv_id") % 5 == 0, "nohost").otherwise("example.org")).alias("email"), F.col("role").alias("source"), F.col("text").alias("description"))
    cleaned = validate.clean_submission(rows)
    return cleaned.select("conv_id", "turn", validate.status_code(cleaned).alias("status_code"))


REQUIRED_SQL = "SELECT conv_id, turn, CASE WHEN role = 'system' OR conv_id % 5 = 0 THEN 400 ELSE 200 END AS status_code FROM conversations"


def _address() -> Column:
    """Addresses of seven kinds, by the first of these that divides the key: 7, 5, 11, 13, 17, 19."""
    k, c = F.col("c_custkey"), F.col("c_custkey").cast("string")
    bad = {7: F.concat(F.lit("a..b@x"), c, F.lit(".org")), 5: F.concat(F.lit("c"), c, F.lit("@host")), 11: F.concat(F.lit(".c"), c, F.lit("@x.org")), 13: F.concat(F.lit("c"), c, F.lit("@-x.org")), 17: F.concat(F.lit("c" * 65), c, F.lit("@x.org")), 19: F.concat(F.lit("c "), c, F.lit("@x.org"))}
    out = F.when(F.lit(False), c)
    for n, address in bad.items():
        out = out.when(k % n == 0, address)
    return out.otherwise(F.concat(F.lit("c+o'x."), c, F.lit("@sub.example-1.org")))


def email_check(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select("c_custkey", validate.email_ok(_address()).alias("ok"))


EMAIL_SQL = "SELECT c_custkey, NOT (c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 OR c_custkey % 19 = 0) AS ok FROM customer"


def intake_status(spark: SparkSession, d: str) -> DataFrame:
    """Request bodies as JSON text, of sixteen kinds by key: whole ones, cut-off ones, lists, numbers, with something behind, within white space, with
    a repeated key, two at once, in another language's quotes, with values that are no text; some are not posted."""
    k = F.col("event_id")
    body = F.to_json(F.struct(F.concat(F.lit(" idea\t "), "event_type").alias("title"), F.when(k % 7 == 0, "nohost").otherwise("u@example.org").alias("email"), F.col("event_type").alias("source"), F.lit("x").alias("more")))
    kinds = [
        F.substring(body, 1, 12), F.lit("[1]"), F.lit("7"), F.concat(body, F.lit(" x")), F.concat(F.lit("\t\n"), body, F.lit("\r\n ")), F.concat(F.lit('{"title":"old",'), F.substring(body, 2, 2**31 - 1)),
        F.lit("[1],[2]"), F.lit("{'title':'a'}"), F.replace(body, F.concat(F.lit('"source":"'), "event_type", F.lit('"')), F.lit('"source":5.0')), F.replace(body, F.lit('"more":"x"'), F.lit('"description":true')),
        F.concat(F.lit("\f"), body), F.lit(""), F.concat(body, F.lit(","), body),
    ]
    raw = F.when(F.lit(False), body)
    for i, kind in enumerate(kinds):
        raw = raw.when(k % 16 == i, kind)
    ev = read_table(spark, d, "events").select("event_id", raw.otherwise(body).alias("raw"), F.when(k % 4 == 3, "GET").otherwise("POST").alias("method"))
    cleaned = validate.clean_submission(intake.parse_submissions(ev, "raw"))
    return cleaned.select("event_id", "title", "source", "description", F.col("corrupt").isNotNull().alias("corrupt"), validate.status_code(cleaned).alias("status_code"))


#: From the rule: a body is one JSON object or list, with JSON's white space around it and nothing else; the last of equal keys counts.
INTAKE_SQL = """SELECT event_id, CASE WHEN bad OR k = 1 THEN '' ELSE 'idea ' || event_type END AS title, CASE WHEN bad OR k = 1 THEN '' WHEN k = 8 THEN '5' ELSE event_type END AS source, CASE WHEN k = 9 THEN '1' ELSE '' END AS description, bad AS corrupt,
CASE WHEN event_id % 4 = 3 THEN 405 WHEN bad OR k = 1 OR event_id % 7 = 0 THEN 400 ELSE 200 END AS status_code FROM (SELECT *, event_id % 16 AS k, event_id % 16 IN (0, 2, 3, 6, 7, 10, 11, 12) AS bad FROM events)"""


def form_checks(spark: SparkSession, d: str) -> DataFrame:
    """Customers fill in each form: blanks, white space and bad addresses by key."""
    k = F.col("c_custkey")
    name, blank = F.col("c_name"), F.lit(" \u00a0\t")
    df = read_table(spark, d, "customer").select(
        "c_custkey", F.when(k % 3 == 0, blank).otherwise(name).alias("title"), F.when(k % 5 == 0, "x@host").otherwise("x@a.example.org").alias("email"), F.col("c_mktsegment").alias("source"),
        F.when(k % 4 != 0, name).alias("description"), name.alias("originator"), F.when(k % 7 != 0, name).alias("username"), F.when(k % 11 == 0, blank).otherwise("V1").alias("postal"),
        name.alias("term"), F.when(k % 13 == 0, "").otherwise(name).alias("expansion"),
    )
    return df.select("c_custkey", *[validate.form_complete(df, f).alias(f) for f in ("server", "export_form", "mail_form", "membership", "glossary", "glossary_typed")])


FORMS_SQL = """SELECT c_custkey, c_custkey % 3 <> 0 AS server, c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AS export_form, c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AS mail_form,
c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 5 <> 0 AS membership, c_custkey % 13 <> 0 AS glossary, true AS glossary_typed FROM customer"""


def daily_asset_id(spark: SparkSession, d: str) -> DataFrame:
    return sequence.assign_ids(read_table(spark, d, "events"), "ts", "event_id").select("event_id", "asset_id")


ASSET_ID_SQL = "SELECT event_id, printf('IPM-%s-%06d', strftime(ts, '%Y%m%d'), row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, event_id)) AS asset_id FROM events"


def asset_id_one_second(spark: SparkSession, d: str) -> DataFrame:
    """A bulk load: all events have one timestamp."""
    ev = read_table(spark, d, "events").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return sequence.assign_ids(ev, "ts", "event_id").select("event_id", "asset_id")


ONE_SECOND_SQL = "SELECT event_id, printf('IPM-20240101-%06d', row_number() OVER (ORDER BY event_id)) AS asset_id FROM events"


def sequence_state(spark: SparkSession, d: str) -> DataFrame:
    return sequence.next_state(read_table(spark, d, "events"), "ts")


STATE_SQL = "SELECT strftime(ts, '%Y%m%d') AS sequence_date, CAST(count(*) AS INTEGER) AS last_number FROM events GROUP BY 1"


def asset_id_continued(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of all events: even ones from an empty state, odd ones from the state that the first left."""
    ev = read_table(spark, d, "events")
    first, second = ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1")
    one = sequence.assign_ids(first, "ts", "event_id")
    two = sequence.assign_ids(second, "ts", "event_id", sequence.next_state(first, "ts"))
    return one.select("event_id", "asset_id").unionByName(two.select("event_id", "asset_id"))


CONTINUED_SQL = """SELECT event_id, printf('IPM-%s-%06d', strftime(ts, '%Y%m%d'), row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY event_id % 2, ts, event_id)) AS asset_id FROM events"""


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events")
    return ev.select("event_id", "ts", F.concat(F.lit(" idea "), "event_type").alias("title"), F.format_string("u%d@example.org", "user_id").alias("email"), F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("event_type")).alias("source"), F.col("props").alias("description"))


def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.ingest(_submissions(spark, d), "ts", "event_id")["ledger"]
    p = F.from_json("event_payload", "title string, source string")
    return out.select("asset_id", "event_type", p["title"].alias("title"), p["source"].alias("source"))


_ACCEPTED = "(SELECT *, printf('IPM-%s-%06d', strftime(ts, '%Y%m%d'), row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, event_id)) AS asset_id FROM events WHERE event_id % 10 <> 0)"
LEDGER_SQL = f"SELECT asset_id, 'idea.locked' AS event_type, 'idea ' || event_type AS title, event_type AS source FROM {_ACCEPTED}"


def idea_rows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest(_submissions(spark, d), "ts", "event_id")["ideas"]


IDEAS_SQL = f"SELECT asset_id, 'idea ' || event_type AS title, 'u' || user_id || '@example.org' AS originator_email, event_type AS source, props AS description, 'draft' AS status, ts AS created_at FROM {_ACCEPTED}"


def asset_rows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest(_submissions(spark, d), "ts", "event_id")["assets"]


ASSETS_SQL = f"SELECT asset_id, '0.1' AS version, 'draft' AS status, ts AS created_at FROM {_ACCEPTED}"


def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.ingest(_submissions(spark, d), "ts", "event_id")["audit_log"]
    return out.select("actor_email", "action", F.from_json("payload", "asset_id string")["asset_id"].alias("asset_id"))


AUDIT_SQL = f"SELECT 'u' || user_id || '@example.org' AS actor_email, 'idea.submit' AS action, asset_id FROM {_ACCEPTED}"


def outbox_rows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest(_submissions(spark, d), "ts", "event_id")["outbox"]


OUTBOX_SQL = f"SELECT asset_id, 'u' || user_id || '@example.org' AS recipient, 'Records Asset ID: ' || asset_id AS subject, 'Hello,' || chr(10) || chr(10) || 'Your idea has been received by Records.' || chr(10) || chr(10) || 'Asset ID: ' || asset_id || chr(10) || 'Idea Title: idea ' || event_type || chr(10) || chr(10) || 'This acknowledgement confirms receipt and timestamping of your submission.' || chr(10) || chr(10) || 'Records' || chr(10) AS body, 'From: Records <noreply@example.org>' || chr(13) || chr(10) || 'Reply-To: noreply@example.org' || chr(13) || chr(10) || 'Content-Type: text/plain; charset=UTF-8' AS headers, ts AS created_at FROM {_ACCEPTED}"


def rejects(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest(_submissions(spark, d), "ts", "event_id")["rejects"].select("event_id", "status_code")


REJECTS_SQL = "SELECT event_id, 400 AS status_code FROM events WHERE event_id % 10 = 0"


def ideas_published(spark: SparkSession, d: str) -> DataFrame:
    """All events as two batches, the first of which is written again after the second; read from the published tables."""
    root, all_ = new_path(spark, "published"), _submissions(spark, d)
    for batch in (0, 1, 0):
        ingest.publish(all_.filter(F.col("event_id") % 2 == batch), "ts", "event_id", root, f"{batch:03d}")
    return published.read_published(spark, root, "ideas", IDEAS)


IDEAS_PUBLISHED_SQL = """SELECT printf('IPM-%s-%06d', strftime(ts, '%Y%m%d'), row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY event_id % 2, ts, event_id)) AS asset_id, 'idea ' || event_type AS title, 'u' || user_id || '@example.org' AS originator_email,
event_type AS source, props AS description, 'draft' AS status, ts AS created_at, printf('%03d', event_id % 2) AS batch FROM events WHERE event_id % 10 <> 0"""


def _mails(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The outbox, and delivery events by user: every third fails, every third fails once and is tried again, the others are sent."""
    mails = ingest.ingest(_submissions(spark, d), "ts", "event_id")["outbox"]
    kind = F.substring_index(F.substring("recipient", 2, 255), "@", 1).cast("long") % 3
    tried = mails.select("asset_id", F.explode(F.when(kind == 0, F.array(F.lit(False))).when(kind == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))).alias("delivered"))
    return mails, tried


def mail_replies(spark: SparkSession, d: str) -> DataFrame:
    return ingest.replies(*_mails(spark, d))


REPLIES_SQL = f"SELECT asset_id, '{{\"ok\":true,\"asset_id\":\"' || asset_id || '\",\"mail_sent\":' || CASE WHEN user_id % 3 = 0 THEN 'false' ELSE 'true' END || '}}' AS reply FROM {_ACCEPTED}"


def mails_undelivered(spark: SparkSession, d: str) -> DataFrame:
    """Every mail comes twice; what is left to send."""
    mails, tried = _mails(spark, d)
    return undelivered(mails.unionByName(mails), tried).select("asset_id", "recipient")


UNDELIVERED_SQL = f"SELECT asset_id, 'u' || user_id || '@example.org' AS recipient FROM {_ACCEPTED} WHERE user_id % 3 = 0"


def days_covered(spark: SparkSession, d: str) -> DataFrame:
    v, day = F.col("value"), F.to_date("ts")
    nxt = money.next_payment(day, v)
    return read_table(spark, d, "events").select("event_id", money.cents(v).alias("amount"), money.days_covered(v).alias("days"), nxt.alias("next_payment"), money.long_date(nxt).alias("next_text"), money.valid_amount(v).alias("active"))


DAYS_SQL = """SELECT event_id, amount, CAST(floor(amount) AS BIGINT) AS days, CAST(ts AS DATE) + CAST(greatest(floor(amount), 1) AS INTEGER) AS next_payment,
strftime(CAST(ts AS DATE) + CAST(greatest(floor(amount), 1) AS INTEGER), '%B %-d, %Y') AS next_text, value > 0 AS active
FROM (SELECT *, CASE WHEN value > 0 THEN floor(value * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS amount FROM events)"""


def amount_choice(spark: SparkSession, d: str) -> DataFrame:
    """Custom amounts as typed: nothing, text, numbers of the browser's and of other grammars."""
    k = F.col("p_partkey")
    typed = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.col("p_size").cast("string"), F.lit("d"))).when(k % 5 == 2, F.concat(F.lit("\u00a00x"), F.lower(F.hex("p_size")))).when(k % 5 == 3, "-3").otherwise(F.concat(F.lit(" +"), F.col("p_size").cast("string"), F.lit(".5e1 ")))
    choice = F.when(k % 2 == 0, 365)
    return read_table(spark, d, "part").select("p_partkey", money.parse_amount(typed).alias("typed"), money.choose_amount(money.parse_amount(typed), choice).alias("amount"))


CHOICE_SQL = """SELECT p_partkey, typed, CAST(CASE WHEN k IN (2, 4) AND typed > 0 THEN typed WHEN p_partkey % 2 = 0 THEN 365 ELSE 1 END AS DOUBLE) AS amount
FROM (SELECT *, p_partkey % 5 AS k, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN p_size WHEN 3 THEN -3 ELSE p_size * 10 + 5 END AS DOUBLE) AS typed FROM part)"""


#: Addresses of payment pages before and after the amount is set, by what browsers do; {n} is the amount. None: no absolute address.
LINKS = (
    ("https://pay.example.org/x?amount=3", "https://pay.example.org/x?amount={n}"),
    ("HTTP://Pay.Example.org:80/x?a=1", "http://pay.example.org/x?a=1&amount={n}"),
    ("https://PASTE_LINK/x", "https://paste_link/x?amount={n}"),
    ("ftp://pay.example.org/X", "ftp://pay.example.org/X?amount={n}"),
    ("https://pay.example.org/x?amount=3&b=2", "https://pay.example.org/x?amount={n}&b=2"),
    ("https://pay.example.org?b=1&amount=3&c=x+y%20z&amount=4#frag", "https://pay.example.org/?b=1&amount={n}&c=x+y+z#frag"),
    ("pay.example.org/x", None),
    ("https://pay.example.org/x?&&q=100%&amount#a?b", "https://pay.example.org/x?q=100%25&amount={n}#a?b"),
)


def payment_url(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of address with each order's total, and whether the page is live (judged before the amount is set)."""
    base = F.get(F.array(*[F.lit(a) for a, _ in LINKS]), F.col("o_orderkey") % len(LINKS))
    return read_table(spark, d, "orders").select("o_orderkey", money.payment_url(base, F.col("o_totalprice")).alias("url"), money.live_url(base).alias("live"))


_AFTER = ", ".join(f"'{b}'" if b else "NULL" for _, b in LINKS)
URL_SQL = rf"""SELECT o_orderkey, replace(([{_AFTER}])[1 + o_orderkey % {len(LINKS)}], '{{n}}', regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\.?0+$', '')) AS url, o_orderkey % {len(LINKS)} NOT IN (2, 3, 6) AS live FROM orders"""


def payment_panel(spark: SparkSession, d: str) -> DataFrame:
    """Typed amounts: blank, no number, padded, negative, far too large; methods are active once there is an amount."""
    k, v = F.col("event_id") % 8, F.col("value")
    typed = F.when(k == 0, "").when(k == 1, "1.2.3").when(k == 2, F.concat(F.lit("\u00a0 "), v.cast("string"), F.lit(" "))).when(k == 3, (-v).cast("string")).when(k == 5, "0x1e").when(k == 6, "5f").when(k == 7, "3e9").otherwise((v * 1000).cast("string"))
    ev = read_table(spark, d, "events").select("event_id", money.parse_amount(typed).alias("parsed"))
    shown = accounting.methods_active(ev.withColumn("amount", money.cents(F.col("parsed"))), "amount")
    return shown.select("event_id", F.isnan("parsed").alias("no_number"), "methods_active", money.currency(F.col("amount")).alias("text"), money.equivalent(F.col("amount")).alias("equivalent"), money.days_covered(F.col("parsed")).alias("days"), money.next_payment(F.lit("2024-01-31").cast("date"), F.col("parsed")).isNull().alias("beyond"))


PANEL_SQL = """SELECT event_id, k IN (1, 6) AS no_number, amount > 0 AS methods_active, '$' || format('{:,.2f}', amount) AS text, CASE amount WHEN 1 THEN 'day' WHEN 7 THEN 'week' WHEN 30 THEN 'month' WHEN 365 THEN 'year' END AS equivalent, CAST(floor(amount) AS BIGINT) AS days, amount > 2900000 AS beyond
FROM (SELECT event_id, k, CASE WHEN v > 0 THEN floor(v * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS amount FROM (SELECT event_id, event_id % 8 AS k, CASE event_id % 8 WHEN 2 THEN value WHEN 3 THEN -value WHEN 4 THEN value * 1000 WHEN 5 THEN 30 WHEN 7 THEN 3000000000 ELSE 0 END AS v FROM events))"""


def encoded_links(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select("p_partkey", text.mailto("a@example.org", F.col("p_name"), F.col("p_type")).alias("mail"), text.search_url("https://s.example.org/?q=", F.col("p_name"), F.col("p_brand")).alias("search"))


LINKS_SQL = "SELECT p_partkey, 'mailto:a@example.org?subject=' || url_encode(p_name) || '&body=' || url_encode(p_type) AS mail, 'https://s.example.org/?q=' || url_encode(p_name || ' ' || p_brand) AS search FROM part"


def allocation(spark: SparkSession, d: str) -> DataFrame:
    o = accounting.with_allocation(read_table(spark, d, "orders"), "o_totalprice")
    return o.select("o_orderkey", "operating", "direct", "secondary", "programme")


_SPLIT = "(SELECT *, CAST(round(a * 0.10, 2) AS DECIMAL(18,2)) AS operating, CAST(round(a * 0.10, 2) AS DECIMAL(18,2)) AS direct, CAST(round(a * 0.01, 2) AS DECIMAL(18,2)) AS secondary FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders))"
ALLOCATION_SQL = f"SELECT o_orderkey, operating, direct, secondary, CAST(a - operating - direct - secondary AS DECIMAL(18,2)) AS programme FROM {_SPLIT}"


def allocation_by_category(spark: SparkSession, d: str) -> DataFrame:
    t = accounting.totals(read_table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return t.select("o_orderpriority", *[F.col(c).cast("double").alias(c) for c in ("money_in", "operating", "direct", "secondary", "programme")], "n")


CATEGORY_SQL = f"SELECT o_orderpriority, CAST(sum(a) AS DOUBLE) AS money_in, CAST(sum(operating) AS DOUBLE) AS operating, CAST(sum(direct) AS DOUBLE) AS direct, CAST(sum(secondary) AS DOUBLE) AS secondary, CAST(sum(a - operating - direct - secondary) AS DOUBLE) AS programme, count(*) AS n FROM {_SPLIT} GROUP BY 1"


def totals_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Money by priority, month and status, by priority and month, by priority, and in all."""
    o = read_table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    t = accounting.totals_by_level(o, "o_totalprice", "o_orderpriority", "month", "o_orderstatus")
    return t.select("level", "o_orderpriority", "month", "o_orderstatus", *[F.col(c).cast("double").alias(c) for c in ("money_in", "operating", "direct", "secondary", "programme")], "n", "n_rejected")


LEVELS_SQL = f"""SELECT CAST(3 - bit_count(CAST(grouping_id(o_orderpriority, month, o_orderstatus) AS BIGINT)) AS INTEGER) AS level, o_orderpriority, month, o_orderstatus, CAST(sum(a) AS DOUBLE) AS money_in, CAST(sum(operating) AS DOUBLE) AS operating, CAST(sum(direct) AS DOUBLE) AS direct, CAST(sum(secondary) AS DOUBLE) AS secondary,
CAST(sum(a - operating - direct - secondary) AS DOUBLE) AS programme, count(*) AS n, CAST(0 AS BIGINT) AS n_rejected FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS month FROM {_SPLIT}) GROUP BY ROLLUP (o_orderpriority, month, o_orderstatus)"""


def commissions(spark: SparkSession, d: str) -> DataFrame:
    """Order status plays the state: F received; priority 1 and 2 play the promoters."""
    o = read_table(spark, d, "orders").withColumns({
        "who": F.when(F.col("o_orderpriority").startswith("1"), "direct promoter").when(F.col("o_orderpriority").startswith("2"), "secondary promoter").otherwise("none"),
        "received": F.col("o_orderstatus") == "F",
        "verified": F.col("o_orderkey") % 2 == 0,
    })
    return accounting.commissions(o, "o_totalprice", "who", "received", "verified").select("o_orderkey", "direct_commission", "secondary_commission", "unallocated")


COMMISSIONS_SQL = f"""SELECT o_orderkey, CAST(d AS DECIMAL(18,2)) AS direct_commission, CAST(s AS DECIMAL(18,2)) AS secondary_commission, CAST(CASE WHEN o_orderstatus = 'F' THEN direct + secondary ELSE 0 END - d - s AS DECIMAL(18,2)) AS unallocated
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' AND left(o_orderpriority, 1) IN ('1', '2') THEN direct ELSE 0 END AS d, CASE WHEN o_orderstatus = 'F' AND left(o_orderpriority, 1) = '2' AND o_orderkey % 2 = 0 THEN secondary ELSE 0 END AS s FROM {_SPLIT})"""


def payout_violations(spark: SparkSession, d: str) -> DataFrame:
    """Users play payouts, event types their states."""
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "purchase", "paid").when(F.col("event_type") == "signup", "held")
    late = F.get(F.array(F.lit("reversed"), F.lit("disputed"), F.lit("lost")), F.col("event_id") % 3)
    ev = read_table(spark, d, "events").withColumn("state", F.coalesce(state, late))
    return accounting.payout_violations(ev, "user_id", "ts", "event_id", "state").select("user_id", "event_id", "from_state", "to_state", "rule")


_ALLOWED = ", ".join(f"'{a}>{b}'" for a, following in accounting.NEXT_STATES.items() for b in following if a)
PAYOUT_VIOLATIONS_SQL = f"""SELECT user_id, event_id, was AS from_state, now AS to_state, rule FROM (SELECT *, CASE WHEN now = 'lost' THEN 'unknown_state' WHEN was IS NULL AND now <> 'pending' THEN 'not_recorded' WHEN now = 'paid' AND was <> 'approved' THEN 'paid_unapproved'
WHEN was IS NOT NULL AND was || '>' || now NOT IN ({_ALLOWED}) THEN 'not_allowed' END AS rule FROM (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT *, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'paid' WHEN 'signup' THEN 'held' ELSE ['reversed', 'disputed', 'lost'][1 + event_id % 3] END AS now FROM events))) WHERE rule IS NOT NULL"""


def payouts_by_month(spark: SparkSession, d: str) -> DataFrame:
    p = accounting.payouts_by_month(read_table(spark, d, "orders"), "o_orderdate", "o_orderstatus", "o_totalprice")
    return p.select("month", "o_orderstatus", F.col("amount").cast("double").alias("amount"), "n")


PAYOUTS_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n FROM orders GROUP BY 1, 2"


def reference_violations(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders that are pending: those orders are not among the parents."""
    parents = read_table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return constraints.reference_violations(read_table(spark, d, "lineitem"), parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


REFERENCE_SQL = "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus <> 'P')"


def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.unique_violations(read_table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


UNIQUE_SQL = "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


def linked_records(spark: SparkSession, d: str) -> DataFrame:
    t = ingest.ingest(_submissions(spark, d), "ts", "event_id")
    return constraints.linked(t["ideas"], t["assets"]).select("asset_id", "title", "version", "asset_status")


LINKED_SQL = f"SELECT asset_id, 'idea ' || event_type AS title, '0.1' AS version, 'draft' AS asset_status FROM {_ACCEPTED}"


def ledger_links(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows with their ideas; ideas of type ``error`` were never stored, so their ledger rows stand alone."""
    t = ingest.ingest(_submissions(spark, d), "ts", "event_id")
    return constraints.ledger_with_ideas(t["ledger"], t["ideas"].filter("source <> 'error'")).select("asset_id", "event_type", "idea_title", "idea_source")


LEDGER_LINKS_SQL = f"SELECT asset_id, 'idea.locked' AS event_type, CASE WHEN event_type <> 'error' THEN 'idea ' || event_type END AS idea_title, CASE WHEN event_type <> 'error' THEN event_type END AS idea_source FROM {_ACCEPTED}"


def _history(spark: SparkSession, df: DataFrame, key: str, result) -> DataFrame:
    """``result`` of a history that two batches were appended to; the table goes when the result is written."""
    table = "history_" + new_path(spark, "x").split("/")[-2]
    for batch in (0, 1):
        constraints.append_history(df.filter(F.col(key) % 2 == batch), table, key, 8)
    try:
        return materialize(result(table), "across")
    finally:
        spark.sql(f"DROP TABLE {table}")


def unreferenced_across(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a batch against the history of orders that are not pending."""
    orders = read_table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return _history(spark, orders.select("o_orderkey", "o_custkey"), "o_orderkey", lambda t: constraints.unreferenced_across(lines, t, "l_orderkey", "o_orderkey"))


def repeated_across(spark: SparkSession, d: str) -> DataFrame:
    """Orders of lines as a batch of keys against the history of orders."""
    batch = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return _history(spark, read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey", lambda t: constraints.repeated_across(batch, t, "o_orderkey"))


REPEATED_ACROSS_SQL = "SELECT l_orderkey AS o_orderkey, count(*) AS n_batch, coalesce(any_value(n), 0) AS n_history FROM lineitem LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 1 OR any_value(n) > 0"


def ideas_by_node(spark: SparkSession, d: str) -> DataFrame:
    """The node field of the form: the event type plays it, padded; ``error`` is no known node."""
    ev = read_table(spark, d, "events").withColumn("node", F.concat(F.lit(" "), "event_type"))
    known = ("click", "view", "purchase", "signup")
    return records.with_node(ev, "node", known).groupBy("assigned_node").agg(F.count("*").alias("n"))


NODES_SQL = "SELECT CASE WHEN event_type IN ('click', 'view', 'purchase', 'signup') THEN event_type END AS assigned_node, count(*) AS n FROM events GROUP BY 1"


def _payments(spark: SparkSession, d: str) -> DataFrame:
    """Orders play payments; every ninth has no amount."""
    k = F.col("o_orderkey")
    return read_table(spark, d, "orders").select(
        k.alias("payment_id"), F.to_date("o_orderdate").alias("received_on"), F.when(k % 9 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"), F.lit("Square").alias("payment_path"),
        F.when(F.col("o_orderpriority").startswith("1"), "direct promoter").when(F.col("o_orderpriority").startswith("2"), "secondary promoter").alias("attribution"), (k % 2 == 0).alias("verified"),
        F.col("o_orderpriority").alias("service_category"), F.when(k % 4 == 0, " ").when(k % 4 == 1, "done").alias("outcome_note"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("is_public"),
        F.lit("sent").alias("receipt_status"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("email"),
    )


_PAID = """(SELECT *, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN CAST(round(a * 0.10, 2) AS DECIMAL(18,2)) ELSE 0 END AS dc, CASE WHEN left(o_orderpriority, 1) = '2' AND o_orderkey % 2 = 0 THEN CAST(round(a * 0.01, 2) AS DECIMAL(18,2)) ELSE 0 END AS sc,
CASE left(o_orderpriority, 1) WHEN '1' THEN 'direct promoter' WHEN '2' THEN 'secondary promoter' ELSE 'none' END AS who,
a - CAST(round(a * 0.10, 2) AS DECIMAL(18,2)) - CAST(round(a * 0.10, 2) AS DECIMAL(18,2)) - CAST(round(a * 0.01, 2) AS DECIMAL(18,2)) AS prog, CAST(round(a * 0.10, 2) AS DECIMAL(18,2)) AS op
FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders) WHERE o_orderkey % 9 <> 0 AND a > 0)"""


def contribution_records(spark: SparkSession, d: str) -> DataFrame:
    c = accounting.contributions(_payments(spark, d))
    return c.select("received_on", "attribution", "outcome_note", "is_public", "service_category", *[F.col(x).cast("double").alias(x) for x in ("amount", "operating", "direct", "secondary", "programme")])


CONTRIBUTIONS_SQL = f"""SELECT CAST(o_orderdate AS DATE) AS received_on, who AS attribution, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'done' END AS outcome_note, o_orderstatus = 'F' AS is_public, o_orderpriority AS service_category,
CAST(a AS DOUBLE) AS amount, CAST(op AS DOUBLE) AS operating, CAST(dc AS DOUBLE) AS direct, CAST(sc AS DOUBLE) AS secondary, CAST(prog AS DOUBLE) AS programme FROM {_PAID}"""


def contribution_events(spark: SparkSession, d: str) -> DataFrame:
    """The ledger event and the mail of each payment."""
    out = accounting.after_payment(_payments(spark, d))
    return out["ledger"].join(out["outbox"].withColumn("asset_id", F.col("payment_id").cast("string")), "asset_id").select("asset_id", "event_type", "event_payload", "recipient", "subject", "body")


CONTRIBUTION_EVENTS_SQL = rf"""SELECT CAST(o_orderkey AS VARCHAR) AS asset_id, 'contribution.recorded' AS event_type, '{{"amount":"' || m || '","payment_path":"Square","attribution":"' || who || '"}}' AS event_payload, 'c' || o_custkey || '@example.org' AS recipient, 'Records: contribution received' AS subject,
'Hello,' || chr(10) || chr(10) || 'Thank you. We received your contribution of $' || m || '.' || chr(10) || chr(10) || 'Records' || chr(10) AS body FROM (SELECT *, regexp_replace(CAST(a AS VARCHAR), '\.?0+$', '') AS m FROM {_PAID})"""


def payments_published(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after a batch of payments was published, twice."""
    root = new_path(spark, "payments")
    for _ in range(2):
        accounting.publish_payments(_payments(spark, d), root, "one")
    return published.read_published(spark, root, "ledger", LEDGER)


PAYMENTS_PUBLISHED_SQL = rf"""SELECT CAST(o_orderkey AS VARCHAR) AS asset_id, 'contribution.recorded' AS event_type, '{{"amount":"' || regexp_replace(CAST(a AS VARCHAR), '\.?0+$', '') || '","payment_path":"Square","attribution":"' || who || '"}}' AS event_payload, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS created_at, 'one' AS batch FROM {_PAID}"""


def public_record(spark: SparkSession, d: str) -> DataFrame:
    t = accounting.public_record(accounting.contributions(_payments(spark, d)))
    return t.select("service_category", *[F.col(c).cast("double").alias(c) for c in ("money_in", "operating", "direct", "secondary", "programme")], "n", "n_outcomes")


PUBLIC_SQL = f"SELECT o_orderpriority AS service_category, CAST(sum(a) AS DOUBLE) AS money_in, CAST(sum(op) AS DOUBLE) AS operating, CAST(sum(dc) AS DOUBLE) AS direct, CAST(sum(sc) AS DOUBLE) AS secondary, CAST(sum(prog) AS DOUBLE) AS programme, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS n_outcomes FROM {_PAID} WHERE o_orderstatus = 'F' GROUP BY 1"


def public_only(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").withColumn("visibility", F.when(F.col("o_orderstatus") == "F", "public").when(F.col("o_orderstatus") == "O", "private"))
    return records.public_only(o).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


PUBLIC_ONLY_SQL = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Parts written out as Markdown records, a row a file."""
    k = F.col("p_partkey").cast("string")
    field = lambda label, v: F.concat(F.lit(f"{label}:\n"), v, F.lit("\n\n"))
    note = F.when(F.col("p_size") > 25, F.concat(F.lit("## Related Nodes\n\n- "), "p_type", F.lit("\n- Core "), "p_brand", F.lit("\n\n"))).otherwise("")
    words = F.concat(F.lit("### "), "p_name", F.lit("\n\n**Expansion:** "), "p_type", F.lit("\n**Our Meaning:** of "), "p_brand", F.lit("\n**Date Added:** 2024-01-02\n\n### end\n\n**Status:** locked\n"))
    text = F.concat(F.lit("# Record\n\n"), field("ASSET ID", F.concat(F.lit("X-"), k)), field("TITLE", F.col("p_name")), field("HISTORY", F.concat(F.lit("0.1 first\n0.2 "), "p_brand")), note, words)
    return read_table(spark, d, "part").select(k.alias("path"), text.alias("text"))


def markdown_assets(spark: SparkSession, d: str) -> DataFrame:
    return markdown.asset_records(_files(spark, d)).select("path", "asset_id", "title", "history", "status")


ASSET_FILES_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS path, 'X-' || p_partkey AS asset_id, p_name AS title, '0.1 first' || chr(10) || '0.2 ' || p_brand AS history, '' AS status FROM part"


def markdown_edges(spark: SparkSession, d: str) -> DataFrame:
    return markdown.node_edges(_files(spark, d), F.col("path"))


EDGES_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS src, unnest([replace(lower(p_type), ' ', '-'), 'core-' || replace(lower(p_brand), '#', '-')]) AS dst FROM part WHERE p_size > 25"


def markdown_glossary(spark: SparkSession, d: str) -> DataFrame:
    return markdown.glossary(_files(spark, d)).select("path", "term", "expansion", "meaning", "status", "date_added")


GLOSSARY_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS term, p_type AS expansion, 'of ' || p_brand AS meaning, '' AS status, '2024-01-02' AS date_added FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'end', '', '', 'locked', '' FROM part"""


def record_body(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name"))
    return c.select("c_custkey", text.record_body(F.lit("Hello,"), text.labelled_block("Name", name), text.labelled_block("Segment", F.col("c_mktsegment"))).alias("body"), text.line_or_blank("Name", F.trim(name)).alias("line"), text.upper_postal(F.col("c_mktsegment")).alias("postal"))


BODY_SQL = "SELECT c_custkey, 'Hello,' || chr(10) || chr(10) || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Name: ' || c_name || chr(10) || chr(10) END || 'Segment: ' || c_mktsegment AS body, 'Name: ' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS line, upper(c_mktsegment) AS postal FROM customer"


def issue_links(spark: SparkSession, d: str) -> DataFrame:
    """The idea as a Markdown record, and the link that opens an issue with it filled in."""
    title = F.when(F.col("p_size") > 40, "  ").otherwise(F.col("p_name"))
    md = text.idea_markdown(title, "LOCK", [("ORIGIN", [text.line_or_blank("Brand", F.col("p_brand"))]), ("STATUS", [F.lit("Status: Draft"), F.lit("Version: 1.0")])])
    p = read_table(spark, d, "part").select("p_partkey", md.alias("body"), title.alias("title"))
    return p.select("p_partkey", "body", text.query_url("https://example.org/new", title=F.col("title"), labels=F.lit("Draft,Core System")).alias("url"))


ISSUE_SQL = """SELECT p_partkey, '# LOCK' || r || '## IDEA' || chr(10) || CASE WHEN p_size > 40 THEN 'Untitled idea' ELSE p_name END || r || '## ORIGIN' || chr(10) || 'Brand: ' || p_brand || r || '## STATUS' || chr(10) || 'Status: Draft' || chr(10) || 'Version: 1.0' AS body,
'https://example.org/new?title=' || CASE WHEN p_size > 40 THEN '++' ELSE replace(url_encode(p_name), '%20', '+') END || '&labels=Draft%2CCore+System' AS url FROM (SELECT *, chr(10) || chr(10) || '---' || chr(10) || chr(10) AS r FROM part)"""


def open_issues(spark: SparkSession, d: str) -> DataFrame:
    """Orders play issues: status the state, priority the labels."""
    o = read_table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "pull").otherwise("issue").alias("kind"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), F.when(F.col("o_orderkey") % 4 != 1, F.split("o_orderpriority", "-")).alias("labels"))
    return records.labelled(o, "URGENT").select("o_orderkey")


ISSUES_SQL = "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'O' AND o_orderkey % 4 <> 1 AND list_contains(string_split(o_orderpriority, '-'), 'URGENT')"


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Stages by number, and the gate that opens where all conditions hold (null: not held)."""
    k = F.col("o_orderkey")
    stage = F.when(k % 5 == 0, "Lock").when(k % 5 == 1, "History").when(k % 5 == 2, "unknown").when(k % 5 == 3, "Idea")
    held = validate.gate(F.col("o_totalprice") > 1000, F.col("o_orderstatus") != "P", F.when(k % 7 != 0, F.lit(True)))
    return read_table(spark, d, "orders").select("o_orderkey", records.stage_number(stage, LIFECYCLE).alias("stage"), held.alias("open"))


LIFECYCLE_SQL = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS stage, o_totalprice > 1000 AND o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AS open FROM orders"


def stage_violations(spark: SparkSession, d: str) -> DataFrame:
    """Users play assets, event types the first stages and the last one; ``error`` is no stage."""
    stage = F.when(F.col("event_type") == "view", "Idea").when(F.col("event_type") == "click", "Lock").when(F.col("event_type") == "purchase", "Asset").when(F.col("event_type") == "signup", "History").otherwise("lost")
    ev = read_table(spark, d, "events").withColumn("stage", stage)
    return records.stage_violations(ev, "user_id", "ts", "event_id", "stage", LIFECYCLE).select("user_id", "event_id", "from_stage", "to_stage", "rule")


STAGE_VIOLATIONS_SQL = """SELECT user_id, event_id, was AS from_stage, stage AS to_stage, rule FROM (SELECT *, CASE WHEN n = 0 THEN 'unknown_stage' WHEN was IS NULL AND n > 1 THEN 'not_first' WHEN w > 0 AND n > w + 1 THEN 'skipped' WHEN w > 0 AND n < w THEN 'backwards' END AS rule
FROM (SELECT *, lag(stage) OVER u AS was, lag(n) OVER u AS w FROM (SELECT *, CASE event_type WHEN 'view' THEN 'Idea' WHEN 'click' THEN 'Lock' WHEN 'purchase' THEN 'Asset' WHEN 'signup' THEN 'History' ELSE 'lost' END AS stage, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 7 ELSE 0 END AS n FROM events) WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))) WHERE rule IS NOT NULL"""


def raw_kept(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned fields stand beside the text as it came."""
    out = validate.clean_submission(_submissions(spark, d))
    return out.select("event_id", "title", "raw_title", "source", "raw_source")


RAW_SQL = "SELECT event_id, 'idea ' || event_type AS title, ' idea ' || event_type AS raw_title, source, source AS raw_source FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type END AS source FROM events)"


def configured_mail(spark: SparkSession, d: str) -> DataFrame:
    """IDs and mails under settings of a deployment."""
    config = ingest.Config("ABC", "office@example.org", "Office", "admin@example.org")
    return ingest.ingest(_submissions(spark, d), "ts", "event_id", None, config)["outbox"].select("asset_id", "subject", "headers")


CONFIGURED_SQL = f"SELECT replace(asset_id, 'IPM', 'ABC') AS asset_id, 'Office Asset ID: ' || replace(asset_id, 'IPM', 'ABC') AS subject, 'From: Office <office@example.org>' || chr(13) || chr(10) || 'Reply-To: admin@example.org' || chr(13) || chr(10) || 'Content-Type: text/plain; charset=UTF-8' AS headers FROM {_ACCEPTED}"


def file_index(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entries of an index file, two a file, and the parts of their names."""
    k = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("2024-05-06_"), F.col("p_type"), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("_of-"), k, F.lit("_draft.md"))
    entry = F.concat(F.lit("- "), name, F.lit("\n  - Type: note.\n  - Tags: "), F.col("p_type"), F.lit(", core.\n  - Suggested path: `01/"), k, F.lit("/x.md`\n\n"))
    files = read_table(spark, d, "part").select(F.concat(F.lit("# Index\n\n"), entry, F.lit("- plain.md\n  - Type: image.\n  - Tags: z.\n  - Suggested path: `plain.md`\n")).alias("text"))
    parts = {c: v for c, v in markdown.file_name_parts(F.col("name")).items()}
    out = markdown.file_index(files).withColumns(parts)
    return out.select("name", "type", F.array_join("tags", "|").alias("tags"), "suggested_path", F.size("path_parts").alias("n_parts"), "date", "category", "description", "status")


INDEX_SQL = """SELECT '2024-05-06_' || p_type || '_' || replace(p_brand, '#', '-') || '_of-' || p_partkey || '_draft.md' AS name, 'note' AS type, p_type || '|core' AS tags, '01/' || p_partkey || '/x.md' AS suggested_path, 3 AS n_parts, '2024-05-06' AS date, replace(p_brand, '#', '-') AS category, 'of-' || p_partkey AS description, 'draft' AS status FROM part
UNION ALL SELECT 'plain.md', 'image', 'z', 'plain.md', 1, '', '', '', '' FROM part"""


def current_versions(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return records.current_versions(o, "o_custkey", "o_orderdate")


VERSIONS_SQL = "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderstatus DESC) = 1"


def version_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Orders play the versions of their customer."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return records.validity(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "valid_from", "valid_to")


INTERVALS_SQL = "SELECT o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders"


def version_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each line's supplier number names a customer: the customer's order that was current when the line was shipped."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    history = read_table(spark, d, "orders").select(F.col("o_custkey").alias("l_suppkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    found = records.as_of(lines, history, "l_suppkey", "l_shipdate", "o_orderdate", "o_orderkey")
    return found.select("l_orderkey", "l_linenumber", "version.o_orderkey", "version.o_orderstatus")


AS_OF_SQL = """SELECT l_orderkey, l_linenumber, o_orderkey, o_orderstatus FROM lineitem l ASOF LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) o ON l.l_suppkey = o.o_custkey AND l.l_shipdate >= o.o_orderdate"""


def record_search(spark: SparkSession, d: str) -> DataFrame:
    return records.search(read_table(spark, d, "part"), "D WID", "p_name", "p_type").select("p_partkey", "p_name", "p_type")


SEARCH_SQL = "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'd wid') OR contains(lower(p_type), 'd wid')"


def record_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same search by an index that two batches were appended to."""
    root, part = new_path(spark, "terms"), read_table(spark, d, "part")
    for batch in (0, 1):
        text_index.append_index(part.filter(F.col("p_partkey") % 2 == batch), "p_partkey", root, "p_name", "p_type")
    return text_index.search_indexed(part, "p_partkey", root, "D WID", "p_name", "p_type").select("p_partkey", "p_name", "p_type")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier to part stands in for the related-node edges, from every row."""
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_edges(spark, d))


_EDGES = "(SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"
DEGREE_SQL = f"SELECT dst AS node, count(*) AS in_degree FROM {_EDGES} GROUP BY 1"


def related_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers to the suppliers of their orders, suppliers to their nation: what a customer is related to in two steps."""
    lines, orders, supplier = (read_table(spark, d, t) for t in ("lineitem", "orders", "supplier"))
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.format_string("customer-%d", "o_custkey").alias("src"), F.format_string("supplier-%d", "l_suppkey").alias("dst")).distinct()
    based = supplier.select(F.format_string("supplier-%d", "s_suppkey").alias("src"), F.format_string("nation-%d", "s_nationkey").alias("dst"))
    return graph.two_step_neighbours(bought.unionByName(based))


RELATED_SQL = "SELECT DISTINCT 'customer-' || o_custkey AS src, 'nation-' || s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"


def node_hops(spark: SparkSession, d: str) -> DataFrame:
    """Steps from the first nation along nations, customers, orders, parts, suppliers and, in a circle, nations."""
    edge = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"))
    lines, orders, customer, supplier = (read_table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    edges = edge(customer, "n", "c_nationkey", "c", "c_custkey").unionByName(edge(orders, "c", "o_custkey", "o", "o_orderkey")).unionByName(edge(lines, "o", "l_orderkey", "p", "l_partkey"))
    edges = edges.unionByName(edge(lines, "p", "l_partkey", "s", "l_suppkey")).unionByName(edge(supplier, "s", "s_suppkey", "n", "s_nationkey"))
    return graph.hops(edges, read_table(spark, d, "nation").filter("n_nationkey = 0").select(F.lit("n0").alias("node")))


HOPS_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
r AS (SELECT 'n0' AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN e ON node = src WHERE hops < 14)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1"""


def case_checklist(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part").withColumn("p_brand", F.when(F.col("p_size") > 10, F.col("p_brand")))
    return validate.checklist(p, ["p_name", "p_brand", "p_type"]).select("p_partkey", "n_done", "complete")


CHECKLIST_SQL = "SELECT p_partkey, CASE WHEN p_size > 10 THEN 3 ELSE 2 END AS n_done, p_size > 10 AS complete FROM part"

QUERIES = {
    "recent_records": (recent_records, RECENT_SQL),
    "response_json": (response_json, RESPONSE_SQL),
    "clean_text": (clean_text, CLEAN_SQL),
    "source_resolution": (source_resolution, SOURCE_SQL),
    "required_fields": (required_fields, REQUIRED_SQL),
    "email_check": (email_check, EMAIL_SQL),
    "daily_asset_id": (daily_asset_id, ASSET_ID_SQL),
    "asset_id_continued": (asset_id_continued, CONTINUED_SQL),
    "sequence_state": (sequence_state, STATE_SQL),
    "ledger_rows": (ledger_rows, LEDGER_SQL),
    "idea_rows": (idea_rows, IDEAS_SQL),
    "asset_rows": (asset_rows, ASSETS_SQL),
    "audit_rows": (audit_rows, AUDIT_SQL),
    "outbox_rows": (outbox_rows, OUTBOX_SQL),
    "rejects": (rejects, REJECTS_SQL),
    "days_covered": (days_covered, DAYS_SQL),
    "amount_choice": (amount_choice, CHOICE_SQL),
    "payment_url": (payment_url, URL_SQL),
    "encoded_links": (encoded_links, LINKS_SQL),
    "allocation": (allocation, ALLOCATION_SQL),
    "allocation_by_category": (allocation_by_category, CATEGORY_SQL),
    "commissions": (commissions, COMMISSIONS_SQL),
    "payouts_by_month": (payouts_by_month, PAYOUTS_SQL),
    "reference_violations": (reference_violations, REFERENCE_SQL),
    "unique_violations": (unique_violations, UNIQUE_SQL),
    "linked_records": (linked_records, LINKED_SQL),
    "record_body": (record_body, BODY_SQL),
    "current_versions": (current_versions, VERSIONS_SQL),
    "record_search": (record_search, SEARCH_SQL),
    "node_degree": (node_degree, DEGREE_SQL),
    "related_nodes": (related_nodes, RELATED_SQL),
    "intake_status": (intake_status, INTAKE_SQL),
    "form_checks": (form_checks, FORMS_SQL),
    "payment_panel": (payment_panel, PANEL_SQL),
    "ledger_links": (ledger_links, LEDGER_LINKS_SQL),
    "ideas_by_node": (ideas_by_node, NODES_SQL),
    "contribution_records": (contribution_records, CONTRIBUTIONS_SQL),
    "contribution_events": (contribution_events, CONTRIBUTION_EVENTS_SQL),
    "public_record": (public_record, PUBLIC_SQL),
    "public_only": (public_only, PUBLIC_ONLY_SQL),
    "issue_links": (issue_links, ISSUE_SQL),
    "open_issues": (open_issues, ISSUES_SQL),
    "lifecycle": (lifecycle, LIFECYCLE_SQL),
    "raw_kept": (raw_kept, RAW_SQL),
    "configured_mail": (configured_mail, CONFIGURED_SQL),
    "file_index": (file_index, INDEX_SQL),
    "markdown_assets": (markdown_assets, ASSET_FILES_SQL),
    "markdown_edges": (markdown_edges, EDGES_SQL),
    "markdown_glossary": (markdown_glossary, GLOSSARY_SQL),
    "case_checklist": (case_checklist, CHECKLIST_SQL),
    "asset_id_one_second": (asset_id_one_second, ONE_SECOND_SQL),
    "ideas_published": (ideas_published, IDEAS_PUBLISHED_SQL),
    "mail_replies": (mail_replies, REPLIES_SQL),
    "mails_undelivered": (mails_undelivered, UNDELIVERED_SQL),
    "totals_by_level": (totals_by_level, LEVELS_SQL),
    "payout_violations": (payout_violations, PAYOUT_VIOLATIONS_SQL),
    "unreferenced_across": (unreferenced_across, REFERENCE_SQL),
    "repeated_across": (repeated_across, REPEATED_ACROSS_SQL),
    "payments_published": (payments_published, PAYMENTS_PUBLISHED_SQL),
    "stage_violations": (stage_violations, STAGE_VIOLATIONS_SQL),
    "version_intervals": (version_intervals, INTERVALS_SQL),
    "version_as_of": (version_as_of, AS_OF_SQL),
    "record_search_indexed": (record_search_indexed, SEARCH_SQL),
    "node_hops": (node_hops, HOPS_SQL),
}
