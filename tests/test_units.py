"""Golden values, edge rows and properties of the record operators."""

import datetime as dt
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import money, text
from tallyloom.operators import accounting, constraints, graph, ingest, records, sequence, validate
from tallyloom.schemas import ASSETS, CONTRIBUTION, IDEAS, INTAKE, LEDGER
from tallyloom.sources import intake, markdown, tables
from tallyloom.sources.published import read_published
from tallyloom.streaming import micro_batch_writer


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [("\t a \n b ", "a b"), (None, ""), (" \x0b\x00", ""), (" a  b", " a b"), ("x" * 4000, "x" * 3000), ("\U0001f600 \U0001f600", "\U0001f600 \U0001f600")])
def test_clean(spark, raw, want):
    assert one(spark, text.clean, raw) == want


def test_trim_kinds(spark):
    assert one(spark, text.browser_trim, "  a ﻿") == "a"
    assert one(spark, text.server_trim, "  a ") == "  a"


def test_blocks_and_urls(spark):
    r = spark.createDataFrame([("  ", "a b&c", None)], "a string, b string, c string").select(
        text.record_body(F.lit("Hi"), text.labelled_block("A", F.col("a")), text.labelled_block("B", F.col("b")), text.labelled_block("C", F.col("c"))).alias("body"),
        text.idea_markdown(F.col("a"), "LOCK", [("ORIGIN", [text.line_or_blank("Email", F.col("c"))])]).alias("md"),
        text.mailto("x@example.org", F.col("b"), F.lit("(é)~")).alias("mail"),
        text.query_url("https://example.org/new", title=F.col("b"), labels=F.lit("Draft,Core System")).alias("url"),
    ).first()
    assert r.body == "Hi\n\nB: a b&c"
    assert r.md == "# LOCK\n\n---\n\n## IDEA\nUntitled idea\n\n---\n\n## ORIGIN\nEmail: "
    assert r.mail == "mailto:x@example.org?subject=a%20b%26c&body=(%C3%A9)~"
    assert r.url == "https://example.org/new?title=a+b%26c&labels=Draft%2CCore+System"


@pytest.mark.parametrize("amount, shares", [(1, "0.10 0.10 0.01 0.79"), (7, "0.70 0.70 0.07 5.53"), (30, "3.00 3.00 0.30 23.70"), (365, "36.50 36.50 3.65 288.35")])
def test_allocation(spark, amount, shares):
    r = accounting.with_allocation(spark.createDataFrame([(Decimal(amount),)], "a decimal(18,2)"), "a").first()
    assert [r.operating, r.direct, r.secondary, r.programme] == [Decimal(x) for x in shares.split()]


@pytest.mark.parametrize("amount, cents, days", [(1.005, 1.0, 1), (0.5, 0.5, 0), (7.0, 7.0, 7), (-3.0, 0.0, 0), (float("nan"), 0.0, 0), (float("inf"), 0.0, 0), (None, 0.0, 0)])
def test_amounts(spark, amount, cents, days):
    r = spark.createDataFrame([(amount, dt.date(2024, 2, 28))], "a double, d date").select(money.cents(F.col("a")).alias("c"), money.days_covered(F.col("a")).alias("n"), money.next_payment(F.col("d"), F.col("a")).alias("next"), money.currency(money.cents(F.col("a"))).alias("text")).first()
    assert (r.c, r.n) == (cents, days) and r.next == dt.date(2024, 2, 28) + dt.timedelta(max(days, 1)) and r.text == f"${cents:,.2f}"


def test_amount_choice_and_urls(spark):
    df = spark.createDataFrame([(0.0, 365.0), (None, None), (5.0, 365.0)], "c double, r double")
    assert [r[0] for r in df.select(money.choose_amount(F.col("c"), F.col("r"))).collect()] == [365.0, 1.0, 5.0]
    urls = spark.createDataFrame([("https://a.example/x", 7.0), ("https://a.example/x?amount=3&b=1", 7.5), ("https://a.example/x?b=1&amount=3", 12345678.9)], "u string, a double")
    assert [r[0] for r in urls.select(money.payment_url(F.col("u"), F.col("a"))).collect()] == ["https://a.example/x?amount=7", "https://a.example/x?amount=7.5&b=1", "https://a.example/x?b=1&amount=12345678.9"]
    assert [one(spark, money.live_url, u) for u in ("HTTPS://a", "", None, "https://PASTE_ME", "ftp://a")] == [True, False, False, False, False]
    assert [one(spark, money.parse_amount, x) for x in ("", None, " 2.5 ")] == [0.0, 0.0, 2.5]


def test_equivalents(spark):
    assert [one(spark, money.equivalent, x, "double") for x in (1.0, 7.0, 30.0, 365.0, 2.0, None)] == ["day", "week", "month", "year", None, None]


def test_email_and_required(spark):
    good, bad = ["a@b.co", "a+b.c@x-y.example.org"], ["", None, "a@b", ".a@b.co", "a..b@c.de", "a@-b.co", "x" * 65 + "@b.co", "a b@c.de"]
    assert [one(spark, validate.email_ok, x) for x in good + bad] == [True] * 2 + [False] * 8
    df = spark.createDataFrame([(" n ", "a@b.co", "V1"), ("n", "a@b", "V1"), ("n", "a@b.co", " ")], "username string, email string, postal string")
    assert [r[0] for r in df.select(validate.form_complete(df, "membership")).collect()] == [True, False, False]


def test_ids_are_dense_and_continue(spark):
    day = dt.datetime(2024, 1, 1, 23, 59, 59)
    rows = [(i, day + dt.timedelta(seconds=i % 7)) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "k long, ts timestamp")
    state = spark.createDataFrame([("20240101", 999_999)], "sequence_date string, last_number int")
    out = {r.k: r.asset_id for r in sequence.assign_ids(df, "ts", "k", state).collect()}
    first = sorted(k for k, t in rows if t == day)
    assert [out[k] for k in first] == [f"IPM-20240101-{1_000_000 + i}" for i in range(len(first))]
    rest = sorted((t, k) for k, t in rows if t and t > day)
    assert [out[k] for _, k in rest] == [f"IPM-20240102-{i + 1:06d}" for i in range(len(rest))] and out[99] is None
    assert {r.sequence_date: r.last_number for r in sequence.next_state(df, "ts", state).collect()} == {"20240101": 999_999 + len(first), "20240102": len(rest)}


def test_intake_to_published_tables(spark, tmp_path):
    lines = ['{"title":" A  b ","email":"a@b.co","source":"Search","x":1}', '{"title":"t","email":"bad","source":"s"}', "[1]", "7", "null", "{", '{"title":"","email":"a@b.co","source":"s"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(lines))
    raw = intake.read_submissions(spark, f"{tmp_path}/in").withColumns({"k": F.monotonically_increasing_id(), "ts": F.lit("2024-01-01 10:00:00").cast("timestamp"), "method": F.lit("POST")})
    assert sorted(r.corrupt for r in raw.filter("corrupt is not null").collect()) == ["7", "null", "{"]
    out = ingest.ingest(raw, "ts", "k")
    ingest.publish(raw, "ts", "k", f"{tmp_path}/db", "001")
    ingest.publish(raw, "ts", "k", f"{tmp_path}/db", "001")
    read = lambda name: read_published(spark, f"{tmp_path}/db", name, INTAKE[name])
    ideas = read("ideas").collect()
    assert [(r.asset_id, r.title, r.status) for r in ideas] == [("IPM-20240101-000001", "A b", "draft")]
    assert {name: df.columns for name, df in ((n, read(n)) for n in INTAKE)} == {name: [*schema.names, "batch"] for name, schema in INTAKE.items()}
    assert read("rejects").count() == 6 and all('"k":' in r.submitted for r in read("rejects").collect())
    assert read("outbox").first().subject.endswith("IPM-20240101-000001")
    assert out["replies"].first().reply == '{"ok":true,"asset_id":"IPM-20240101-000001","mail_sent":false}'
    tables.append(out["ledger"], f"{tmp_path}/ledger", LEDGER)
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 1
    wrong = raw.withColumn("method", F.lit("GET"))
    assert {r.status_code for r in ingest.ingest(wrong, "ts", "k")["rejects"].collect()} == {405}


SUBMITTED = "k long, title string, email string, source string, description string, ts timestamp"


def test_stream_publishes_batches(spark, tmp_path):
    spark.createDataFrame([(1, "t", "a@b.co", "s", "d", dt.datetime(2024, 1, 1))], SUBMITTED).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SUBMITTED).parquet(f"{tmp_path}/in")
    write = micro_batch_writer(spark, f"{tmp_path}/db", "ts", "k")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert read_published(spark, f"{tmp_path}/db", "assets", ASSETS).first().version == "0.1"


def test_a_replayed_batch_keeps_its_ids(spark, tmp_path):
    """The marker was written, the stream's own commit was not: the batch comes again, even after a later one."""
    rows = lambda a, n: spark.createDataFrame([(i, f"t{i}", "a@b.co", "s", "d", dt.datetime(2024, 1, 1)) for i in range(a, a + n)], SUBMITTED)
    write = micro_batch_writer(spark, f"{tmp_path}/db", "ts", "k")
    ids = lambda: {r.title: r.asset_id for r in read_published(spark, f"{tmp_path}/db", "ideas", IDEAS).collect()}
    write(rows(0, 3), 0)
    write(rows(10, 2), 1)
    first = ids()
    assert sorted(first.values()) == [f"IPM-20240101-{i:06d}" for i in range(1, 6)] and first["t10"].endswith("4")
    write(rows(10, 2), 1)
    write(rows(0, 3), 0)
    assert ids() == first
    write(rows(20, 1), 2)
    assert ids()["t20"] == "IPM-20240101-000006"


def test_unpublished_batches_are_not_read(spark, tmp_path):
    raw = spark.createDataFrame([(1, "t", "a@b.co", "s", "d", dt.datetime(2024, 1, 1))], SUBMITTED)
    ingest.publish(raw, "ts", "k", f"{tmp_path}/db", "b1")
    raw.write.parquet(f"{tmp_path}/db/ideas/batch=b-half/attempt=x")
    raw.write.parquet(f"{tmp_path}/db/ideas/batch=b-b1/attempt=x")
    assert [r.batch for r in read_published(spark, f"{tmp_path}/db", "ideas", IDEAS).collect()] == ["b1"]


def test_trims_take_linear_time(spark):
    began = time.perf_counter()
    long = "x" + " " * 1_000_000 + "\u00a0" * 1_000_000 + "x"
    df = spark.createDataFrame([(long,), ("!" * 1_000_000,), (" " * 1_000_000,)], "s string")
    out = df.select(F.length(text.server_trim(F.col("s"))).alias("a"), F.length(text.browser_trim(F.col("s"))).alias("b"), F.length(text.clean(F.col("s"))).alias("c")).collect()
    assert [tuple(r) for r in out] == [(len(long), len(long), 3), (1_000_000, 1_000_000, 3000), (0, 0, 0)]
    assert time.perf_counter() - began < 10


def test_after_payment(spark):
    rows = [(1, dt.date(2024, 1, 2), Decimal("7.00"), "tap", None, True, "Intake", None, None, "sent", "a@b.co"), (2, dt.date(2024, 1, 2), None, "tap", "none", True, "Intake", "x", True, "sent", "a@b.co"), (3, dt.date(2024, 1, 3), Decimal("100"), "tap", "secondary promoter", True, "Intake", "housed", True, "sent", "c@b.co")]
    df = spark.createDataFrame(rows, "payment_id long, received_on date, amount decimal(18,2), payment_path string, attribution string, verified boolean, service_category string, outcome_note string, is_public boolean, receipt_status string, email string")
    out = accounting.after_payment(df)
    assert [r.body.split("$")[1].split(".\n")[0] for r in out["outbox"].orderBy("payment_id").collect()] == ["7", "100"]
    assert [(f.name, f.dataType) for f in out["contributions"].schema] == [(f.name, f.dataType) for f in CONTRIBUTION] and out["contributions"].count() == 2
    assert [(float(r.money_in), float(r.secondary), r.n, r.n_outcomes) for r in accounting.public_record(out["contributions"]).collect()] == [(100.0, 1.0, 1, 1)]


def test_records(spark):
    h = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "k string, v int, t string")
    assert sorted(map(tuple, records.current_versions(h, "k", "v").collect())) == [("a", 3, "z"), ("b", 1, "q")]
    assert records.search(h, "Z", "t").count() == 1
    issues = spark.createDataFrame([("issue", "open", ["L"]), ("issue", "closed", ["L"]), ("pull", "open", ["L"]), ("issue", "open", None)], "kind string, state string, labels array<string>")
    assert records.labelled(issues, "L").count() == 1
    df = spark.createDataFrame([("Lock",), ("no",), (None,)], "s string")
    assert [r[0] for r in df.select(records.stage_number(F.col("s"), ("Idea", "Lock"))).collect()] == [2, 0, None]
    assert constraints.unique_violations(h, "k").collect()[0].n_rows == 3
    g = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")], "src string, dst string")
    assert sorted(map(tuple, graph.two_step_neighbours(g).collect())) == [("a", "c"), ("b", "a"), ("c", "b")]
    assert {r.node: r.in_degree for r in graph.in_degree(g).collect()} == {"a": 2, "b": 1, "c": 1}


def test_commissions(spark):
    rows = [(100, "direct promoter", True, True), (100, "secondary promoter", True, True), (100, "secondary promoter", True, False), (100, None, True, True), (100, "direct promoter", False, True)]
    df = spark.createDataFrame(rows, "a int, who string, received boolean, verified boolean")
    got = [(float(r.direct_commission), float(r.secondary_commission), float(r.unallocated)) for r in accounting.commissions(df, "a", "who", "received", "verified").collect()]
    assert got == [(10, 0, 1), (10, 1, 0), (10, 0, 1), (0, 0, 11), (0, 0, 0)]


def test_markdown_records(spark, tmp_path):
    (tmp_path / "asset.md").write_text("# X-1\n\nASSET ID:\nX-1\n\nTITLE:\nA thing\n\nHISTORY:\n0.1 first\n0.2 second\n")
    (tmp_path / "node.md").write_text("# N\n\n## Related Nodes\n\n- Public Services\n- Core\n\n## Next\n\n- not me\n")
    (tmp_path / "words.md").write_text("# G\n\n### gfn\n\n**Expansion:** good for now\n\n**Our Meaning:** fine\n\n### x\n\n**Status:** Active\n")
    (tmp_path / "index.md").write_text("- logo.png\n  - Type: image.\n  - Tags: a, b c.\n  - Suggested path: `01/X/logo.png`\n\n- next.md\n  - Type: note.\n  - Tags: z.\n  - Suggested path: `02/next.md`\n")
    read = lambda n: markdown.read_files(spark, f"{tmp_path}/{n}.md")
    r = markdown.asset_records(read("asset")).first()
    assert (r.asset_id, r.title, r.history, r.terms) == ("X-1", "A thing", "0.1 first\n0.2 second", "")
    assert [tuple(x) for x in markdown.node_edges(read("node"), F.lit("n")).collect()] == [("n", "public-services"), ("n", "core")]
    assert [(x.term, x.expansion, x.meaning, x.status) for x in markdown.glossary(read("words")).collect()] == [("gfn", "good for now", "fine", ""), ("x", "", "", "Active")]
    assert [(x.name, x.type, x.tags, x.path_parts) for x in markdown.file_index(read("index")).collect()] == [("logo.png", "image", ["a", "b c"], ["01", "X", "logo.png"]), ("next.md", "note", ["z"], ["02", "next.md"])]
    parts = spark.createDataFrame([("2026-06-17_a_b_c-d_gfn.html",), ("x.md",)], "n string").select(*[c.alias(k) for k, c in markdown.file_name_parts(F.col("n")).items()]).collect()
    assert tuple(parts[0]) == ("2026-06-17", "a", "b", "c-d", "gfn", "html") and set(parts[1]) == {""}


def test_gate_and_checklist(spark):
    df = spark.createDataFrame([(True, True, "x", None), (True, None, "x", "y")], "a boolean, b boolean, c string, d string")
    assert [r[0] for r in df.select(validate.gate(F.col("a"), F.col("b"))).collect()] == [True, False]
    assert [(r.n_done, r.complete) for r in validate.checklist(df, ["c", "d"]).collect()] == [(1, False), (2, True)]


def test_recent_records_plan(spark):
    df = spark.range(100).selectExpr("cast(id as string) asset_id", "'t' title", "'s' source", "'d' status", "timestamp_seconds(id) created_at", "'private' originator_email")
    plan = records.recent_records(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "originator_email" not in plan


def test_sources_need_configuration(spark):
    with pytest.raises(ValueError, match="incomplete"):
        tables.read_jdbc(spark, "", "ideas")


def test_jdbc_round_trip(spark, tmp_path):
    """The database that comes with Spark plays the relational one."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    if not spark._jvm.java.lang.ClassLoader.getSystemClassLoader().getResource("org/apache/derby/iapi/jdbc/AutoloadedDriver.class"):
        pytest.skip("no database driver")
    df = spark.createDataFrame([(1, "A", dt.datetime(2024, 1, 1, 2, 3, 4)), (2, None, None)], "k long, name string, ts timestamp")
    tables.write_jdbc(df, url, "ideas", driver=driver)
    tables.write_jdbc(df.filter("k = 2"), url, "ideas", driver=driver)  # appends
    back = tables.read_jdbc(spark, url, "ideas", driver=driver, partitionColumn="k", lowerBound="1", upperBound="3", numPartitions="2")
    assert back.rdd.getNumPartitions() == 2
    assert sorted(tuple(r) for r in back.filter("name IS NOT NULL").collect()) == [(1, "A", dt.datetime(2024, 1, 1, 2, 3, 4))] and back.count() == 3


def test_glossary_of_many_entries(spark):
    files = spark.createDataFrame([("a", "head\n" + "### t\n" * 100_002), ("b", ""), ("c", None)], "path string, text string")
    assert markdown.glossary(files).count() == 100_002
