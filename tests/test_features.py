"""Order without hot tasks, publishing, history, graphs, search by index, delivery."""

import datetime as dt
import random
import threading
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import accounting, constraints, graph, ingest, numbering, records, sequence, text_index
from tallyloom.schemas import ASSET_SEQUENCES, DELIVERIES, IDEAS, LEDGER, LIFECYCLE, OUTBOX
from tallyloom.sources import published
from tallyloom.sources.published import read_batch, read_published
from tallyloom.streaming import deliver, drain, micro_batch_writer
from tallyloom.streaming.delivery import read_deliveries

DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def test_a_million_rows_of_one_second(spark):
    """Ranges share the rows: none has more than twice the mean, and the numbers are those of one sorted list."""
    df = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), F.lit(DAY).alias("ts"))
    rows = numbering._ranges(df, ["ts"], ["k"])
    sizes = [r["count"] for r in rows.groupBy("__range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    out = sequence.assign_ids(df, "ts", "k")
    n = out.agg(F.count_distinct("asset_id"), F.min("sequence_number"), F.max("sequence_number")).first()
    assert tuple(n) == (1_000_000, 1, 1_000_000)
    pairs = out.select("k", "sequence_number").sample(0.001, 1).collect()
    assert all((a.k < b.k) == (a.sequence_number < b.sequence_number) for a, b in pairwise(pairs)) and len(pairs) > 100


@pytest.mark.parametrize("seed", range(3))
def test_numbers_and_previous_values(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "a", "a", "b", ""]), rng.choice([None, 1, 2, 3]), i, rng.choice([None, "x", "y"])) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, id int, v string").repartition(3)
    first = lambda r: (r[1] is not None, r[1] or 0, r[2])
    number, previous, last, following = {}, {}, {}, {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=first)
        for i, r in enumerate(mine):
            number[r[2]] = i
            previous[r[2]] = mine[i - 1][3] if i else None
            last[r[2]] = next((x[3] for x in reversed(mine[:i]) if x[3] == "x"), None)
            following[r[2]] = mine[i + 1][2] if i + 1 < len(mine) else None
    assert {r.id: r.number for r in numbering.number_rows(df, ["g"], ["o", "id"]).collect()} == number
    assert {r.id: r.previous for r in numbering.with_previous(df, ["g"], ["o", "id"], F.col("v")).collect()} == previous
    assert {r.id: r.p for r in numbering.with_previous(df, ["g"], ["o", "id"], F.col("v"), "p", F.col("v") == "x").collect()} == last
    down = [F.col("o").desc_nulls_last(), F.desc("id")]
    assert {r.id: r.p for r in numbering.with_previous(df, ["g"], down, F.col("id"), "p").collect()} == following
    assert numbering.with_previous(df.limit(0), ["g"], ["o", "id"], F.col("v")).count() == 0
    assert sorted(r.number for r in numbering.number_rows(df, [], ["id"]).collect()) == list(range(200))


SUBMITTED = "k long, title string, email string, source string, description string, ts timestamp"


def ideas_of(spark, root):
    return {r.title: r.asset_id for r in read_published(spark, root, "ideas", IDEAS).collect()}


def submissions(spark, first, n, ts=DAY):
    return spark.createDataFrame([(i, f"t{i}", "a@b.co", "s", "d", ts) for i in range(first, first + n)], SUBMITTED)


def test_readers_see_a_replayed_batch_as_it_was_or_is(spark, tmp_path):
    """A reader counts all the time while a published batch is written again three times."""
    root = f"{tmp_path}/db"
    ingest.publish(submissions(spark, 0, 50), "ts", "k", root, "001")
    first, seen, done = ideas_of(spark, root), [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(read_published(spark, root, "ideas", IDEAS).count())

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(3):
        ingest.publish(submissions(spark, 0, 50), "ts", "k", root, "001")
    done.set()
    reader.join()
    assert set(seen) == {50} and len(seen) > 2 and ideas_of(spark, root) == first
    published.forget(spark, root, "ideas", "001")
    assert len(list((tmp_path / "db" / "ideas" / "batch=b-001").glob("attempt=*"))) == 1 and ideas_of(spark, root) == first


@pytest.mark.parametrize("dies_at", ["ideas", "head", "manifest"])
def test_a_job_that_dies_and_comes_again(spark, tmp_path, monkeypatch, dies_at):
    """The second batch dies at each step; nothing of it is seen, and run again it gets the IDs that it would have had."""
    root = f"{tmp_path}/db"
    write = micro_batch_writer(spark, root, "ts", "k")
    write(submissions(spark, 0, 3), 0)
    put, text = published.Attempt.put, published._put

    def no_table(self, df, name, schema=None):
        if name == dies_at:
            raise OSError("lost")
        return put(self, df, name, schema)

    def no_file(session, path, value):
        if f"/{dies_at}" in path:
            raise OSError("lost")
        text(session, path, value)

    monkeypatch.setattr(published.Attempt, "put", no_table)
    monkeypatch.setattr(published, "_put", no_file)
    with pytest.raises(OSError, match="lost"):
        write(submissions(spark, 10, 2), 1)
    monkeypatch.undo()
    assert sorted(ideas_of(spark, root)) == ["t0", "t1", "t2"] and published.head(spark, root) == f"{0:012d}"
    write(submissions(spark, 10, 2), 1)
    write(submissions(spark, 20, 1), 2)
    ids = ideas_of(spark, root)
    assert [ids[t][-6:] for t in ("t0", "t1", "t2", "t10", "t11", "t20")] == [f"{i:06d}" for i in range(1, 7)]
    write(submissions(spark, 10, 2), 1)  # the stream's own commit was lost
    assert ideas_of(spark, root) == ids


def test_work_of_a_batch_does_not_grow(spark, tmp_path, monkeypatch):
    """However many batches there are, a batch reads the counters of the one before and the same few small files."""
    root, read, looked = f"{tmp_path}/db", [], []
    batch_of, get = ingest.read_batch, published._get
    monkeypatch.setattr(ingest, "read_batch", lambda s, r, n, b, schema: read.append(b) or batch_of(s, r, n, b, schema))
    monkeypatch.setattr(published, "_get", lambda s, path: looked.append(path) or get(s, path))
    counts = []
    for n in range(5):
        read.clear()
        looked.clear()
        ingest.publish(submissions(spark, 10 * n, 2, DAY + dt.timedelta(days=n % 2)), "ts", "k", root, f"{n:03d}")
        counts.append(len(looked))
        assert read == ([f"{n - 1:03d}"] if n else [])
    assert len(set(counts[1:])) == 1
    state = read_batch(spark, root, "asset_sequences", "004", ASSET_SEQUENCES)
    assert {r.sequence_date: r.last_number for r in state.collect()} == {"20240101": 6, "20240102": 4} and state.filter("updated_at IS NULL").count() == 0


def test_counters_that_others_used_cannot_change(spark, tmp_path):
    root = f"{tmp_path}/db"
    for n in range(2):
        ingest.publish(submissions(spark, 10 * n, 2), "ts", "k", root, str(n))
    with pytest.raises(ValueError, match="counters"):
        ingest.publish(submissions(spark, 0, 3), "ts", "k", root, "0")
    assert len(ideas_of(spark, root)) == 4
    ingest.publish(submissions(spark, 10, 5), "ts", "k", root, "1")  # the last one may change
    assert len(ideas_of(spark, root)) == 7 and ingest.state_before(spark, root, "2").first().last_number == 7


def test_rows_without_a_time_take_the_clock(spark, tmp_path):
    df = submissions(spark, 0, 2).withColumn("ts", F.when(F.col("k") == 0, F.col("ts")))
    ingest.publish(df, "ts", "k", f"{tmp_path}/db", "1", clock=F.lit(dt.datetime(2024, 5, 6)))
    rows = read_published(spark, f"{tmp_path}/db", "ideas", IDEAS).collect()
    assert sorted((r.asset_id, r.created_at) for r in rows) == [("IPM-20240101-000001", DAY), ("IPM-20240506-000001", dt.datetime(2024, 5, 6))]
    ingest.publish(df, "ts", "k", f"{tmp_path}/own", "1")
    first = sorted(map(tuple, read_published(spark, f"{tmp_path}/own", "ideas", IDEAS).collect()))
    ingest.publish(df, "ts", "k", f"{tmp_path}/own", "1")  # later, with the clock of the first time
    assert sorted(map(tuple, read_published(spark, f"{tmp_path}/own", "ideas", IDEAS).collect())) == first
    out = ingest.ingest(df.drop("ts"), "ts", "k")["ideas"]
    assert out.filter("created_at IS NULL OR asset_id IS NULL").count() == 0 and out.count() == 2


def test_payments_are_published(spark, tmp_path):
    pay = spark.createDataFrame([(1, dt.date(2024, 1, 2), 7.5, "tap", None, True, "Intake", None, True, "sent", "a@b.co"), (2, dt.date(2024, 1, 2), 1e20, "tap", None, True, "Intake", None, True, "sent", "a@b.co")], "payment_id long, received_on date, amount double, payment_path string, attribution string, verified boolean, service_category string, outcome_note string, is_public boolean, receipt_status string, email string")
    for _ in range(2):
        accounting.publish_payments(pay, f"{tmp_path}/db", "1")
    assert [(r.asset_id, r.event_payload) for r in read_published(spark, f"{tmp_path}/db", "ledger", LEDGER).collect()] == [("1", '{"amount":"7.5","payment_path":"tap","attribution":"none"}')]
    assert [(r.asset_id, r.recipient) for r in read_published(spark, f"{tmp_path}/db", "outbox", OUTBOX).collect()] == [("1", "a@b.co")]


def test_versions_as_of_a_time(spark):
    """Late versions, several of one time, references before any version, without a key or a time, and repeated ones."""
    history = spark.createDataFrame([("a", at(5), 1, "x"), ("a", at(5), 2, "y"), ("a", at(1), 3, "late"), ("b", at(2), 1, None), (None, at(1), 1, "n"), ("a", None, 9, "q")], "k string, since timestamp, seq int, v string")
    refs = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(1)), (3, "a", at(4)), (4, "a", at(5)), (5, "b", at(9)), (6, "c", at(3)), (7, None, at(3)), (8, "a", None), (9, "a", at(99)), (9, "a", at(99))], "id int, k string, at timestamp")
    found = records.as_of(refs, history, "k", "at", "since", "seq")
    assert sorted((r.id, r.version and (r.version.seq, r.version.v)) for r in found.collect()) == [(1, None), (2, (3, "late")), (3, (3, "late")), (4, (2, "y")), (5, (1, None)), (6, None), (7, None), (8, None), (9, (2, "y")), (9, (2, "y"))]
    spans = records.validity(history.filter("since IS NOT NULL"), "k", "since", "seq").collect()
    assert sorted((str(r.k), r.v, r.valid_from, r.valid_to) for r in spans if r.k != "b") == [("None", "n", at(1), None), ("a", "late", at(1), at(5)), ("a", "x", at(5), at(5)), ("a", "y", at(5), None)]
    assert records.as_of(refs.limit(0), history, "k", "at", "since", "seq").count() == 0
    assert [r.version for r in records.as_of(refs, history.limit(0), "k", "at", "since", "seq").collect()] == [None] * 10


@pytest.mark.parametrize("seed", range(2))
def test_versions_as_of_against_a_scan(spark, seed):
    """One key holds most rows."""
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c"])
    history = [(key(), at(rng.randint(0, 50)), i) for i in range(120)]
    refs = [(i, key(), at(rng.randint(0, 60))) for i in range(300)]
    found = records.as_of(spark.createDataFrame(refs, "id int, k string, at timestamp").repartition(3), spark.createDataFrame(history, "k string, since timestamp, seq int").repartition(2), "k", "at", "since", "seq")
    want = {i: max(((s, q) for h, s, q in history if h == k and s <= t), default=(None, None))[1] for i, k, t in refs}
    assert {r.id: r.version and r.version.seq for r in found.collect()} == want


def test_payout_and_stage_rules(spark):
    rows = [("p", 1, "pending"), ("p", 2, "paid"), ("p", 3, "approved"), ("q", 1, "approved"), ("q", 2, None), ("r", 1, "pending"), ("r", 2, "approved"), ("r", 3, "paid"), ("r", 4, "reversed"), ("r", 5, "pending"), ("s", 1, "paid"), ("t", 1, "lost"), ("u", 1, "pending"), ("u", 2, "held"), ("u", 3, "approved"), ("u", 4, "paid")]
    df = spark.createDataFrame([(e, at(t), t, s) for e, t, s in rows], "id string, ts timestamp, k int, state string")
    got = sorted((r.id, r.k, r.rule) for r in accounting.payout_violations(df, "id", "ts", "k", "state").collect())
    assert got == [("p", 2, "paid_unapproved"), ("p", 3, "not_allowed"), ("q", 1, "not_recorded"), ("q", 2, "unknown_state"), ("r", 5, "not_allowed"), ("s", 1, "not_recorded"), ("t", 1, "unknown_state")]
    steps = [("a", 1, "Idea"), ("a", 2, "Lock"), ("a", 3, "Lock"), ("a", 4, "History"), ("a", 5, "Asset"), ("b", 1, "Lock"), ("b", 2, "x"), ("b", 3, "Asset"), ("c", 1, None)]
    df = spark.createDataFrame([(e, at(t), t, s) for e, t, s in steps], "id string, ts timestamp, k int, stage string")
    got = sorted((r.id, r.k, r.rule) for r in records.stage_violations(df, "id", "ts", "k", "stage", LIFECYCLE).collect())
    assert got == [("a", 4, "skipped"), ("a", 5, "backwards"), ("b", 1, "not_first"), ("b", 2, "unknown_stage"), ("c", 1, "unknown_stage")]


@pytest.mark.parametrize("seed", range(2))
def test_hops(spark, seed):
    """A sparse graph with cycles, loops, null ends and repeated edges; several sources; a limit."""
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(80)] + [(1, 1), (None, 2), (2, None), (0, 70), (70, 71), (71, 0)] * 2
    hops, level, seen = {0: 0, 5: 0, 99: 0}, {0, 5, 99}, {0, 5, 99}
    while level:
        level = {b for a, b in edges if a in level and b is not None} - seen
        seen |= level
        hops |= dict.fromkeys(level, max(hops.values()) + 1)
    df = spark.createDataFrame(edges, "src int, dst int")
    sources = spark.createDataFrame([(0,), (5,), (5,), (99,), (None,)], "s int")
    assert {r.node: r.hops for r in graph.hops(df, sources).collect()} == hops and graph.hops(df, sources).count() == len(hops)
    assert {r.node: r.hops for r in graph.hops(df, sources, 2).collect()} == {k: v for k, v in hops.items() if v <= 2}
    assert graph.hops(df, sources.limit(0)).count() == 0 and graph.hops(df.limit(0), sources).count() == 3


def plan_of(df):
    """The plan that ran, or will."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_round_of_hops_moves_only_its_ends(spark, monkeypatch):
    """Neither the edges nor the nodes seen so far are moved again, in any round; nothing is left in the catalog."""
    plans, step = [], graph._next_nodes

    def watched(*tables):
        out = step(*tables)
        plans.append(plan_of(out))
        return out

    monkeypatch.setattr(graph, "_next_nodes", watched)
    monkeypatch.setattr(graph, "partitions", lambda df: 4)
    before = len(spark.catalog.listTables())
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(3, 0)], "src int, dst int")
    got = graph.hops(edges, spark.createDataFrame([(0,)], "s int"))
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(6)] and len(spark.catalog.listTables()) == before
    assert len(plans) == 6
    for plan in plans:
        assert plan.count("Bucketed: true") >= 2 and plan.count("Exchange hashpartitioning") == 1


def test_fields_are_cleaned_once(spark):
    """What is taken from a batch reads the coded rows as they were written; no field is cleaned or matched again."""
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), " a ", "a@b.co", "s", "d"), (2, None, "", "a@b", "s", None)], "k long, ts timestamp, title string, email string, source string, description string")
    out = ingest.ingest(df, "ts", "k")
    assert [r.k for r in out["rejects"].collect()] == [2] and [r.title for r in out["ideas"].collect()] == ["a"]
    for name in ("rejects", "ideas", "ledger"):
        plan = plan_of(out[name])
        assert "FileScan parquet" in plan and "regexp_replace" not in plan and "RLIKE" not in plan


def test_history_is_not_moved(spark):
    """Two batches of history; a new batch comes to them with the only exchange."""
    rows = spark.createDataFrame([(f"a{i}", i) for i in range(40)] + [(None, 1)], "asset_id string, v int")
    for part in (rows.filter("v < 20"), rows.filter("v >= 20")):
        constraints.append_history(part, "kept_history", "asset_id", 4)
    batch = spark.createDataFrame([("a1",), ("a1",), ("new",), ("new",), ("one",), ("a39",), (None,)], "asset_id string")
    found = constraints.repeated_across(batch, "kept_history", "asset_id")
    missing = constraints.unreferenced_across(batch, "kept_history", "asset_id", "asset_id")
    joined = constraints.with_history(batch, "kept_history", "asset_id", "v")
    assert sorted(map(tuple, found.collect())) == [("a1", 2, 1), ("a39", 1, 1), ("new", 2, 0)]
    assert sorted(r.asset_id for r in missing.collect()) == ["new", "new", "one"]
    assert sorted(str(r.v) for r in joined.collect()) == ["1", "1", "39", "None", "None", "None", "None"]
    for df in (found, missing, joined):
        plan = plan_of(df)
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan
    spark.sql("DROP TABLE kept_history")


def test_totals_take_one_shuffle(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "m", 2.0), (None, "m", 1e20)], "c string, m string, amount double")
    out = accounting.totals_by_level(df, "amount", "c", "m")
    assert sorted((r.level, str(r.c), str(r.m), str(r.money_in), r.n, r.n_rejected) for r in out.collect()) == [(0, "None", "None", "3.00", 3, 1), (1, "None", "None", "None", 1, 1), (1, "a", "None", "3.00", 2, 0), (2, "None", "m", "None", 1, 1), (2, "a", "None", "1.00", 1, 0), (2, "a", "m", "2.00", 1, 0)]
    assert plan_of(out).count("Exchange") == 1


def test_search_by_index(spark, tmp_path):
    rng = random.Random(1)
    say = lambda: "".join(rng.choice("aAbé\U0001f600 ") for _ in range(rng.randint(0, 9)))
    rows = [(i, say(), None if i % 7 == 0 else say()) for i in range(300)] + [(300 + i, "aaaa", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    root = f"{tmp_path}/terms"
    for part in (df.filter("id < 100"), df.filter("id >= 100 AND id < 450"), df.filter("id >= 450"), df.limit(0)):
        text_index.append_index(part, "id", root, "a", "b")
    for text in ("aAb", "AAA", "é\U0001f600 ", "bb", "", "zzzz", "aab a", "aaaa"):
        want = sorted(r.id for r in records.search(df, text, "a", "b").collect())
        assert sorted(r.id for r in text_index.search_indexed(df, "id", root, text, "a", "b").collect()) == want, text
    plan = plan_of(text_index.matching_keys(spark, root, "aaaa", "bigint"))
    assert "(bucket#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "EqualTo(term,aaa)" in plan


def test_a_mail_that_comes_twice_leaves_once(spark, tmp_path):
    """Copies within a batch, in a later batch, after a restart with a lost checkpoint; failed deliveries are tried again."""
    mail = lambda n: (f"id{n}", "a@b.co", "s", "b", "h", at(n))
    left = f"{tmp_path}/left"

    def send(mails):
        sent = mails.select("asset_id", (F.col("asset_id") != "id2").alias("delivered"))
        sent.write.mode("append").parquet(left)
        return sent

    for n, batch in enumerate(([mail(1), mail(1), mail(2)], [mail(1), mail(3)], [mail(2)])):
        spark.createDataFrame(batch, OUTBOX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/out")
        stream = drain(spark.readStream.schema(OUTBOX).parquet(f"{tmp_path}/out"))
        checkpoint = f"{tmp_path}/cp{n // 2}"  # a new one for the last batch: all mails come again
        stream.writeStream.foreachBatch(deliver(spark, f"{tmp_path}/db", send)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.asset_id for r in spark.read.parquet(left).collect()) == ["id1", "id2", "id2", "id3"]
    events = read_deliveries(spark, f"{tmp_path}/db")
    assert events.schema == DELIVERIES and sorted((r.asset_id, r.delivered) for r in events.collect()) == [("id1", True), ("id2", False), ("id2", False), ("id3", True)]
    mails = spark.createDataFrame([mail(1), mail(2), mail(4)], OUTBOX)
    assert sorted(r.reply for r in ingest.replies(mails, events).collect()) == [f'{{"ok":true,"asset_id":"id{n}","mail_sent":{str(n == 1).lower()}}}' for n in (1, 2, 4)]
