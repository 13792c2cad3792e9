import hashlib
from collections import defaultdict

import duckdb

from tallyloom.llm import mixing

D = "/root/testdata/sf0.01"


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = sorted(con.execute(mixing.OP8_SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.op8_fair_queueing(spark, D).collect())
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_taken(spark):
    texts = {None: 40, "a": 10, "b": 400, "Z": 90, "é": 0, "c": 1000, "d": 5}
    rows = []
    for s, n in texts.items():
        rows += [(len(rows), "w " * (n // 3), s, "x"), (len(rows) + 1, "w  \n" * (n - n // 3), s, "x"), (len(rows) + 2, None, s, "x"), (7777, "", s, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    sizes = {s: n for s, n in texts.items()}
    want = brute_targets(sizes)
    got = {r.source: r for r in mixing.source_targets(df.select("source", mixing.word_count().alias("size"))).collect()}
    assert {k: round(v.target, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    out = mixing.taken(df).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    by = {}
    for r in out:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    budget = sum(want.values())
    for (_, target), t in by.items():
        assert target - mixing.QUANTUM - 1 <= sum(t) <= target * (1 + len(texts) * mixing.QUANTUM / budget) + 1 or target == 0
    assert sum(r.taken for r in out) == int(budget)
    assert sorted(map(tuple, mixing.taken(df).collect())) == sorted(map(tuple, out))


def plain_mix(rows, weights_of):
    """(doc_id, taken) from one sorted list: every queued slice of every document, cut at the budget."""
    order = sorted(rows, key=lambda r: (r[2] or "", hashlib.md5(f"mix{r[0]}/{r[1]}".encode()).hexdigest()))
    at, slices = {}, []
    sizes = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in weights_of}
    for doc, text, source, *_ in order:
        n, begin = len(text.split()), at.get(source, 0)
        at[source] = begin + n
        for turn in range(2):
            for a in range(0, n, mixing.QUANTUM):
                w = min(mixing.QUANTUM, n - a)
                slices.append(((begin + turn * sizes[source] + a + w) / weights_of[source], hashlib.md5(f"mix{doc}/{text}".encode()).hexdigest(), doc, turn, a, w))
    left, out = int(sum(weights_of.values())), dict.fromkeys((r[0] for r in rows), 0)
    for _, _, doc, _, _, w in sorted(slices):
        out[doc] += min(w, left)
        left -= min(w, left)
    return out


def test_slices_and_mix(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i % 50 if i % 77 else 900)), f"s{i % 4}" if i % 3 else "hot", 1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    one = sorted(map(tuple, mixing.taken(df).collect()))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    targets = brute_targets(sizes)
    assert {r[0]: r[4] for r in one} == plain_mix(rows, targets)
    keep, mixing.SLICE, mixing.RANGE = (mixing.SLICE, mixing.RANGE), 3, 500
    try:
        assert sorted(map(tuple, mixing.taken(df.repartition(7)).collect())) == one
        out = mixing.mix(df)
        assert out.columns == df.columns
        got = out.collect()
    finally:
        mixing.SLICE, mixing.RANGE = keep
    words, place, at = {}, {}, 0
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert rows[r.doc_id][1].startswith(r.text)
    assert words == {r[0]: r[4] for r in one if r[4]}
    half = defaultdict(int)  # each source is served at its rate all along: half of the mix has half of its target
    for r in got:
        if at < sum(targets.values()) / 2:
            half[r.source] += len(r.text.split())
        at += len(r.text.split())
    assert all(abs(half[s] - t / 2) < 1200 for s, t in targets.items())
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    none = df.withColumn("text", mixing.F.lit(None).cast("string"))
    assert {(r.target, r.taken) for r in mixing.taken(none).collect()} == {(0.0, 0)} and mixing.mix(none).count() == 0


def test_equal_and_null_ids(spark):
    df = spark.createDataFrame([(None, f"a b c {i}", "s") for i in range(50)] + [(7, "x y z", None)] * 3 + [(7, "x", None)], "doc_id long, text string, source string")
    out = mixing.taken(df).collect()
    assert len(out) == 54 and all(0 <= r.taken <= 2 * r.size for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.taken(df.repartition(3)).collect()))
