import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import substrings
from tallyloom.llm.fm_index import FmIndex, WaveletTree

D = "/root/testdata/sf0.001"


def brute(docs):
    """docs: (order, id, bytes) in order."""
    return sorted(in_order(docs))


def in_order(docs):
    seen, out = {}, []
    for k, doc, t in docs:
        w = t.split()
        gone = bytearray(len(w))
        for p in range(len(w) - 19):
            if seen.setdefault(tuple(w[p : p + 20]), (k, p)) != (k, p):
                gone[p : p + 20] = b"\1" * 20
        out.append((str(doc), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_whole_table(spark):
    docs = sorted((r.doc_id, r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    rows = sorted(map(tuple, substrings.op12_fm_index(spark, D).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    want = sorted((int(d), n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute(docs))
    assert rows == want and sum(r[2] for r in rows) > 0


def made(seed):
    rng = random.Random(seed)
    words = ["alpha", "be", "x\x1cy", "δelta", "e", "\U0001f600"]
    space = [" ", "  ", "\n", "\t \x0b", " ", " "]
    say = lambda n: "".join(rng.choice(words) + rng.choice(space) for _ in range(n))
    common = [say(60) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = rng.choice(["", " ", "\n\n"]) + say(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common).split()
            a = rng.randint(0, 30)
            t += rng.choice([" ", "\n"]).join(c[a : a + rng.randint(15, 60)]) + " " + say(rng.randint(0, 9))
        texts.append(t)
    near = say(100)
    texts += [near[: (i * 37) % 400] + "#" + near[(i * 37) % 400 :] for i in range(30)]
    return texts + [texts[0]] * 5 + ["a " * 19, "a " * 20, "a " * 21, " a" * 700, "ab c " * 300, "", " ", "w" * 3000, common[0] * 40]


@pytest.mark.parametrize("seed", range(3))
def test_made_texts(spark, seed):
    texts = made(seed)
    ids = random.Random(seed).sample(range(-50, 1000), len(texts))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, key int, sha string").repartition(5)
    docs = sorted((i, i, t.encode()) for i, t in zip(ids, texts))
    want = brute(docs)
    assert got(substrings.without_repeats(df)) == want
    if seed == 0:
        assert got(substrings.without_repeats(df, 2000, 3000)) == want  # hot anchors, small shards
    rows = [(i, t.encode()) for i, t in zip(ids, texts)]
    keep = substrings.BLOCK, substrings.REMEMBERED, substrings.GATHERED
    try:  # small limits: the same marks without Spark
        substrings.BLOCK, substrings.REMEMBERED, substrings.GATHERED = 300, 3, 40
        for most, step in ((1 << 30, 1 << 30), (1 << 30, 500), (900, 400)):
            assert local(rows, most, step) == want
    finally:
        substrings.BLOCK, substrings.REMEMBERED, substrings.GATHERED = keep


def local(rows, most, step):
    """The plan's steps on lists, in batches of seven rows."""
    import pyarrow as pa

    def batches(data, *names):
        for i in range(0, len(data), 7):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*data[i : i + 7])], list(names))

    flat = lambda bs: [tuple(r.values()) for b in bs for r in b.to_pylist()]
    found = sorted(flat(substrings._find(batches(rows, "key", "text"))), key=lambda r: r[0])
    places = {}
    for key, pos in flat(substrings._match(batches(found, "h", "key", "pos"))):
        places.setdefault(key, []).append(pos)
    pieces = flat(substrings._pieces(batches([(k, t, places[k]) for k, t in rows if k in places], "key", "text", "places")))
    pieces.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    schema = substrings.arrow_schema(substrings._PIECE)
    sent = (pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in pieces[i : i + 7]], schema=schema) for i in range(0, len(pieces), 7))
    spans, firsts, hot = {}, {}, []
    for key, a, z, digest in flat(substrings._search(sent, most, step)):
        if digest is None:
            spans.setdefault(key, []).append((a, z))
        else:
            firsts[digest] = min(firsts.get(digest, (key, a)), (key, a))
            hot.append((key, a, z, digest))
    for key, a, z, digest in hot:
        if (key, a) > firsts[digest]:
            spans.setdefault(key, []).append((a, z))
    out = []
    for key, t in rows:
        w = t.split()
        gone = {i for a, z in spans.get(key, ()) for i in range(a, z)}
        out.append((str(key), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def test_edges(spark):
    """Null and repeated ids, repeated rows, null texts, texts that differ in white space alone, an empty table."""
    t = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(None, t[0]), (None, t[0]), (None, t[1]), (3, t[1]), (3, t[1]), (3, t[0].replace(" ", "\n")), (3, None), (4, ""), (4, None), (5, t[2] + " " + t[2]), (6, "v" * 2_000_000 + " " + t[2])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    sha = lambda x: hashlib.sha256(x.encode()).digest()
    named = sorted({(d is not None, d or 0, sha(x or ""), x or "") for d, x in rows})  # documents in order
    found = in_order([(i, d if known else None, text.encode()) for i, (known, d, _, text) in enumerate(named)])
    results = {(d if known else None, text): r for (known, d, _, text), r in zip(named, found)}
    assert got(substrings.without_repeats(df)) == sorted(results[d, x or ""] for d, x in rows)
    assert substrings.without_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_matching_statistics(seed):
    """Queries with words and stretches that no piece has."""
    rng = random.Random(seed)
    for _ in range(60):
        k, cap = rng.choice([1, 2, 5, 30]), rng.choice([1, 2, 3, 5, 20])
        pieces = [[rng.randrange(k) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 8))]
        ids = np.array([x for p in pieces for x in p])
        place = rng.sample(range(1000), len(ids))
        index = FmIndex(ids, np.array([len(p) for p in pieces]), np.array(place), cap)
        queries = [[rng.randrange(-1, k + 1) for _ in range(rng.randint(0, 30))] for _ in range(5)] + pieces[:2]
        length, number = index.matching_statistics(np.array([x for q in queries for x in q], np.int64), np.array([len(q) for q in queries]))
        parts, firsts, at = set(), {}, 0
        for p in pieces:
            for i in range(len(p)):
                parts |= {tuple(p[i:j]) for j in range(i + 1, len(p) + 1)}
                if i + cap <= len(p):
                    w = tuple(p[i : i + cap])
                    firsts[w] = min(firsts.get(w, 9999), place[at + i])
            at += len(p)
        at = 0
        for q in queries:
            for i in range(len(q)):
                m = next((m for m in range(min(cap, len(q) - i), 0, -1) if tuple(q[i : i + m]) in parts), 0)
                assert length[at + i] == m and (number[at + i] >= 0) == (m == cap)
                assert m < cap or index.first[number[at + i]] == firsts[tuple(q[i : i + cap])]
            at += len(q)


def test_wavelet_tree_counts_and_is_small():
    rng = np.random.default_rng(1)
    seq = rng.zipf(1.5, 20_000) % 500
    tree = WaveletTree(seq, 500)
    symbol, place = rng.choice(seq, 300), rng.integers(0, len(seq) + 1, 300)
    assert tree.rank(symbol, place).tolist() == [int((seq[:i] == s).sum()) for s, i in zip(symbol, place)]
    p = np.bincount(seq)[np.unique(seq)] / len(seq)
    assert sum(len(x.words) * 64 for x in tree.levels) < len(seq) * (1 - (p * np.log2(p)).sum()) + 64 * len(tree.levels)
