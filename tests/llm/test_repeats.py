import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import repeats, suffixes

D = "/root/testdata/sf0.001"


def brute(docs):
    """docs: (key order, id, bytes) in order."""
    seen, out = {}, []
    for k, doc, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if seen.setdefault(w, (k, p)) != (k, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((str(doc), len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_whole_table(spark):
    docs = sorted((r.doc_id, r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    rows = got(repeats.op1_suffix_repeats(spark, D))
    assert rows == brute(docs) and sum(r[2] for r in rows) > 0


def made(seed):
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma ray", "δelta", "e", "\U0001f600", "zeta\n"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [say(60) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = say(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            a = rng.randint(0, 40)
            t += c[a : a + rng.randint(50, 260)] + say(rng.randint(0, 9))
        texts.append(t)
    near = say(300)
    texts += [near[: (i * 37) % 900] + "#" + near[(i * 37) % 900 :] for i in range(30)]
    return texts + [texts[0]] * 5 + ["a" * 99, "a" * 100, "a" * 101, "a" * 700, "ab" * 300, "", "x" * 30, common[0] * 40]


@pytest.mark.parametrize("seed", range(3))
def test_made_texts(spark, seed):
    texts = made(seed)
    ids = random.Random(seed).sample(range(-50, 1000), len(texts))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, key int, sha string").repartition(5)
    docs = sorted((i, i, t.encode()) for i, t in zip(ids, texts))
    keep = repeats.BLOCK, repeats.SORTED, repeats.REMEMBERED, repeats.GATHERED, repeats.HOT
    assert got(repeats.repeats(df)) == brute(docs)
    rows = df.select("doc_id", repeats.F.col("text").cast("binary").alias("text")).collect()
    try:  # small limits: the same marks without Spark
        repeats.BLOCK, repeats.SORTED, repeats.REMEMBERED, repeats.GATHERED = 500, 3000, 3, 40
        assert local(rows) == brute(docs)
        repeats.HOT = 2000
        assert local(rows) == brute(docs)
    finally:
        repeats.BLOCK, repeats.SORTED, repeats.REMEMBERED, repeats.GATHERED, repeats.HOT = keep


def test_a_short_passage_before_very_many_texts(spark):
    """One 40-byte passage before different texts: its anchors' contexts do not fit one comparison, and
    the same rows come out. Some texts share what follows."""
    rng = random.Random(9)
    tail = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(3000)]
    texts = ["The passage that stands at every beginning: " + (tail[i] if i % 10 else tail[i % 30]) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = brute([(i, i, t.encode()) for i, t in enumerate(texts)])
    keep, repeats.HOT, repeats.SORTED = (repeats.HOT, repeats.SORTED), 10_000, 5_000
    try:
        assert got(repeats.repeats(df)) == want
        plan = repeats.marks(df.selectExpr("doc_id AS key", "cast(text AS binary) AS text"), df.limit(0).selectExpr("doc_id AS key"))
        assert plan._jdf.queryExecution().toString().count("Union") > 0  # the windows of a hot anchor were dealt
    finally:
        repeats.HOT, repeats.SORTED = keep


def local(rows):
    """The map functions one after the other, whole copies included."""
    import pyarrow as pa

    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([bytes(r[1]) for r in some], pa.binary())], names=["key", "text"])
    parts = [rows[i::3] for i in range(3)]
    found = [x for p in parts for b in repeats._find(iter([batch(p[:9]), batch(p[9:])])) for x in zip(*[c.to_pylist() for c in b.columns])]
    found.sort()
    some = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[i : i + 50])], names=["h", "key", "pos"]) for i in range(0, len(found), 50)]
    places = {}
    for b in repeats._match(iter(some)):
        for k, p in zip(*[c.to_pylist() for c in b.columns]):
            places.setdefault(k, []).append(p)
    contexts = []
    for p in parts:
        p = [r for r in p if r[0] in places]
        if p:
            b = batch(p)
            b = pa.RecordBatch.from_arrays([*b.columns, pa.array([places[r[0]] for r in p], pa.list_(pa.int64()))], names=["key", "text", "places"])
            contexts += [x for c in repeats._contexts(iter([b])) for x in zip(*[v.to_pylist() for v in c.columns])]
    contexts.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    schema = repeats.arrow_schema(repeats._CONTEXT)
    some = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*contexts[i : i + 7]), schema)], schema=schema) for i in range(0, len(contexts), 7)]
    marks, windows = {}, {}
    for b in repeats._mark(iter(some), repeats.HOT, repeats.SORTED):
        for k, a, z, digest in zip(*[c.to_pylist() for c in b.columns]):
            if digest is None:
                marks.setdefault(k, []).append((a, z))
            else:
                windows.setdefault(digest, []).append((k, a, z))
    for at in windows.values():
        for k, a, z in sorted(at)[1:]:
            marks.setdefault(k, []).append((a, z))
    out = []
    for k, t in rows:
        spans = repeats._union(marks.get(k, []))
        t, kept, at = bytes(t), b"", 0
        for a, z in spans:
            kept, at = kept + t[at:a], z
        out.append((str(k), len(t), sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept + t[at:]).hexdigest()))
    return sorted(out)


def test_edges(spark):
    a, b = "q" * 50 + "r" * 80, "p" * 40 + "s" * 90
    rows = [(3, a), (3, a), (1, None), (2, ""), (5, a + b), (5, b), (None, a), (7, a + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted({((d is not None, d or 0, hashlib.sha256((t or "").encode()).hexdigest()), d, (t or "").encode()) for d, t in rows})
    want = brute(order)
    want += [r for r in want if r[0] == "3"]
    assert got(repeats.repeats(df)) == sorted(want)
    assert repeats.repeats(df.limit(0)).count() == 0


def test_sorting_equals_sorted():
    rng = random.Random(5)
    for _ in range(200):
        letters, shallow = rng.choice([b"ab", b"abc\0", bytes(range(256))]), rng.choice([0, 8, 16])
        base = bytes(rng.choice(letters) for _ in range(200))
        strings = []
        for _ in range(rng.randint(1, 60)):
            n = rng.randint(shallow, 120)
            k = rng.randint(0, n)
            strings.append((base[:k] + bytes(rng.choice(letters) for _ in range(n)))[:n])
        group = sorted(rng.randint(0, 3) for _ in strings)
        ends = np.cumsum([0] + [len(s) for s in strings])
        order, common = suffixes.deep_shallow(np.frombuffer(b"".join(strings), np.uint8), ends[:-1], np.diff(ends), np.array(group), shallow)
        key = [(group[i], strings[i]) for i in order]
        assert key == sorted(key)
        for i, c in enumerate(common.tolist()):
            if i == 0 or key[i][0] != key[i - 1][0]:
                assert c == -1
            else:
                x, y = key[i - 1][1], key[i][1]
                assert c == next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))


def test_every_window_has_its_anchor():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 3, 4000).astype(np.uint8)
    ends = np.array([50, 150, 150, 1200, 1299, 4000])
    h, pos, first, last = suffixes.anchors(buf, ends)
    windows = [s for f, z in zip(first.tolist(), last.tolist()) for s in range(f, z + 1)]
    begins = np.concatenate(([0], ends[:-1]))
    assert windows == [s for b, e in zip(begins.tolist(), ends.tolist()) for s in range(b, e - 99)]
    assert all(f <= p and p + suffixes.GRAM <= z + 100 and p >= z for f, z, p in zip(first.tolist(), last.tolist(), pos.tolist()))
