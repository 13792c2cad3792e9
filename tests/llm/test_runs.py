import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import runs

D = "/root/testdata/sf0.001"


def brute(t, least=6, times=4):
    """(start, end, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(t) // times + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            if i + q - s >= max(least, times * q) and i > s:
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(t, found):
    gone = {i for s, e, q in found for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(t) if i not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.mark.parametrize("seed", range(4))
def test_made_sequences(seed):
    rng = random.Random(seed)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            t = []
            for _ in range(rng.randint(0, 5)):
                u = [rng.randint(0, 2) for _ in range(rng.randint(1, 5))]
                t += u * rng.randint(1, 7) + u[: rng.randint(0, len(u))]
            texts.append(t)
        least, times = rng.choice([(6, 4), (2, 2), (4, 3)])
        got = runs.runs_of(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]), least, times)
        want, at = [], 0
        for t in texts:
            want += [(s + at, e + at, q) for s, e, q in brute(t, least, times)]
            at += len(t)
        assert list(zip(*map(np.ndarray.tolist, got))) == want


def test_sorted_suffixes_and_prefixes():
    ids, sizes = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2]), np.array([6, 4])
    text, left = np.repeat([0, 1], sizes), np.array([6, 5, 4, 3, 2, 1, 4, 3, 2, 1])
    names, order, level = runs.suffix_names(ids, text, left)
    suffix = lambda p: ids[p : p + left[p]].tolist()
    assert order.tolist() == sorted(range(10), key=lambda p: (text[p], suffix(p))) and names[-1][order].tolist() == list(range(10))
    lcp = runs.common_prefixes(names, order, level, left).tolist()
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp == [0] + [share(suffix(a), suffix(b)) if text[a] == text[b] else 0 for a, b in zip(order, order[1:])]


def test_whole_table(spark):
    """The query against brute force on texts whose tail is repeated by plain Python."""
    want = []
    for r in spark.read.parquet(f"{D}/documents.parquet").collect():
        t, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and t:
            g, n = h // 10, len(t)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = [t[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute(t)
        best = max(found, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
        top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        want.append((r.doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept(t, found).encode()).hexdigest()))
    got = runs.op11_branching_tandems(spark, D)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want) and sum(r[1] > 0 for r in rows) > 10


def test_edges(spark):
    """Nulls, empty and blank texts, repeated rows, other white space, columns that clash, null and repeated ids."""
    texts = [None, "", " \t\n", "a", "a a a a a a", "a a " * 6, "x\x1cy x\x1cy x\x1cy x\x1cy x\x1cy x\x1cy", "b a a a a a a c\n\nb a a a a a a c", "\U0001f600 é " * 5]
    rows = [(i % 4 if i % 5 else None, t, "x", [1]) for i, t in enumerate(texts + texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs string, collapsed array<int>")
    got = sorted((str(r.doc_id), [(x.start, x.start + x.length, x.period) for x in r.runs], r.collapsed) for r in runs.find_runs(df).collect())
    assert got == sorted((str(d), brute(words_of(t)), kept(words_of(t), brute(words_of(t)))) for d, t, _, _ in rows)
    assert runs.find_runs(df.limit(0)).count() == 0
    tails = df.select(runs.repeated_tail(runs.text_of(), runs.F.col("doc_id")).alias("t")).collect()
    assert len(tails) == len(rows) and all(r.t is not None for r in tails)


def test_long_texts_and_one_block(spark):
    """A text beyond the block, one word of megabytes, a period of thousands, all in seconds."""
    keep, runs.BLOCK = runs.BLOCK, 1000
    began = time.perf_counter()
    try:
        long = " ".join(str(i % 7001) for i in range(100_000))
        one = "w" * 3_000_000
        rows = [(1, long), (2, one), (3, "a " * 200_000), (4, f"{one} " * 2)]
        local = [(r["doc_id"], r["runs"], r["collapsed"]) for b in runs._search(iter([pa_batch(rows)]), 6, 4) for r in b.to_pylist()]
    finally:
        runs.BLOCK = keep
    run = lambda s, n, q: [{"start": s, "length": n, "period": q}]
    assert [x[1] for x in local] == [run(0, 100_000, 7001), [], run(0, 200_000, 1), []]
    assert local[0][2] == " ".join(map(str, range(7001))) and local[1][2] == one and local[2][2] == "a" and local[3][2] == f"{one} {one}"
    assert time.perf_counter() - began < 20


def pa_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].encode() for r in rows], pa.binary())], ["doc_id", "text"])
