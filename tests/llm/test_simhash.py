import functools
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import simhash as s
from tallyloom.llm.graphs import components

D = "/root/testdata/sf0.01"


def fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(docs, most=3):
    fps = np.array([fp(t) for _, t in docs], np.uint64)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    low = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted((str(k), f"{int(fps[i]):016x}", low.get(find(i))) for i, (k, _) in enumerate(docs))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert got(s.op6_anchor_covering(spark, D)) == brute(docs)


def test_edges_and_one_of_each(spark):
    docs = [(4, None), (3, ""), (9, " \n"), (7, "A b"), (8, "a B"), (8, "a B"), (5, "x"), (None, "only null"), (None, "only null"), (11, "É é ñ \U0001f600 " * 9000), (1, "One two three four"), (2, "one TWO three four")]
    df = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, root string, fp int")
    assert got(s.near_duplicates(df)) == brute(docs)
    out = s.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["3", "7", "5", "None", "11", "1"])
    assert s.near_duplicates(df.limit(0)).count() == 0 and s.one_of_each(df.limit(0)).count() == 0


def test_close_pairs_meet_at_an_anchor():
    rng = np.random.default_rng(3)
    f = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for n in range(4):
        g = f.copy()
        for i in range(len(g)):
            for b in rng.choice(64, n, replace=False):
                g[i] ^= np.uint64(1 << int(b))
        ka, ia = s.anchors(f)
        kb, ib = s.anchors(g)
        a = set(zip(ka.tolist(), ia.tolist()))
        assert {i for k, i in zip(kb.tolist(), ib.tolist()) if (k, i) in a} == set(range(len(f)))
    assert np.bincount(ia).max() <= 32


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 300), st.integers(0, 99), st.booleans(), st.integers(0, 3))
def test_anchors_give_the_classes_of_all_pairs(n, seed, dense, most):
    """Close families through all their anchors: the same classes as from all pairs."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)[rng.integers(0, 4, n)]
    for _ in range(2):
        base = base ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    f = np.unique(base)
    keys, at = s.anchors(f)
    o = np.argsort(keys, kind="stable")
    keep = s.DENSE, s.FINE
    s.DENSE, s.FINE = (4, 12) if dense else keep
    try:
        found, _ = s.links(keys[o], f[at[o]], most)
    finally:
        s.DENSE, s.FINE = keep
    assert len(found) < len(o)
    one, two = s.Forest(len(f)), s.Forest(len(f))
    for i, j in found:
        a, b = int(at[o[i]]), int(at[o[j]])
        assert np.bitwise_count(f[a] ^ f[b]) <= most
        one.join(np.array([a]), np.array([b]))
    for i in range(len(f)):
        j = np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= most) + i + 1
        two.join(np.full(len(j), i), j)
    assert [one.find(i) for i in range(len(f))] == [two.find(i) for i in range(len(f))]


def test_crowded_anchors_do_not_take_all_pairs():
    """One anchored half for all, whose other halves are random: below 2 % of the pairs, and far below where there are many."""
    rng = np.random.default_rng(5)
    for n, share in ((2000, 0.02), (8000, 0.001), (32_000, 0.0008)):
        f = rng.integers(0, 2**32, n, dtype=np.uint64) << np.uint64(32) | np.uint64(12345)
        near = f ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 31, n).astype(np.uint64), np.uint64(0))
        for x in (f, near):
            _, pairs = s.links(np.zeros(n, np.int64), x)
            assert pairs < share * n * (n - 1) / 2


def test_crowded_anchors_of_candidates_do_not_take_all_pairs():
    """All rows at one anchor: the share of pairs that are compared falls; strangers give no candidates, near ones are found."""
    rng = np.random.default_rng(9)
    shares = []
    for n in (2000, 8000, 32_000):
        other, sketch = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        sketch[1::50], other[1::50] = sketch[0::50] ^ np.uint64(0xFFFFFFFF0000), other[0::50] ^ np.uint64(7)  # two of four hashes left
        found, pairs = s.close_links(np.zeros(n, np.int64), other, sketch)
        assert sorted(tuple(sorted(x)) for x in found) == [(i, i + 1) for i in range(0, n, 50)]
        shares.append(pairs / (n * (n - 1) / 2))
    assert shares[0] < 0.02 and shares == sorted(shares, reverse=True) and shares[2] < 0.0002


@pytest.mark.parametrize("dense", [3, 48])
def test_candidates_are_the_same_in_passes(dense):
    rng = np.random.default_rng(dense)
    n = 400
    keys = np.sort(rng.integers(0, 6, n))
    base = rng.integers(0, 2**64, (2, 5), dtype=np.uint64)[:, rng.integers(0, 5, n)]
    other = base[0] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * np.uint64(3)
    sketch = base[1] ^ np.where(rng.random(n) < 0.5, rng.integers(0, 2**64, n, dtype=np.uint64), np.uint64(0))
    keep, s.DENSE = s.DENSE, dense
    try:
        found, _ = s.close_links(keys, other, sketch, 3)
    finally:
        s.DENSE = keep
    lane = lambda a, b: any((int(sketch[a]) ^ int(sketch[b])) >> 16 * k & 0xFFFF == 0 for k in range(4))
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if keys[i] == keys[j] and (int(other[i]) ^ int(other[j])).bit_count() <= 3 and lane(i, j)]
    assert components_of(n, found) == components_of(n, want) and want


def test_a_close_family_does_not_take_all_pairs():
    rng = np.random.default_rng(11)
    n = 4000
    flips = rng.random((n, 64)) < 0.04
    f = np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel() ^ np.uint64(987654321)
    f[:40] = rng.integers(0, 2**64, 40, dtype=np.uint64)  # strangers at the same anchor
    one, two = s.Forest(n), s.Forest(n)
    pairs = s._compare(one, np.arange(n), np.zeros(n, np.int64), s._within(f, s.FAR))
    for i in range(n):
        j = np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= s.FAR) + i + 1
        two.join(np.full(len(j), i), j)
    assert [one.find(i) for i in range(n)] == [two.find(i) for i in range(n)]
    assert pairs < 0.06 * n * (n - 1) / 2


def test_pairs_compared_for_candidates_are_few():
    """Random fingerprints: at all anchors together about 64 * 64 / 2**28 of all pairs meet."""
    rng = np.random.default_rng(6)
    for n in (20_000, 40_000):
        keys = np.concatenate([s.anchors(rng.integers(0, 2**64, n, dtype=np.uint64))[0] | k << 48 for k in (0, 1)])
        met = np.bincount(np.unique(keys, return_counts=True)[1])
        pairs = sum(c * k * (k - 1) // 2 for k, c in enumerate(met.tolist()))
        assert pairs < 3e-5 * n * (n - 1) / 2


def test_bit_counts():
    rng = np.random.default_rng(7)
    n = np.array([1, 255, 256, 700, 3])
    h = rng.integers(0, 2**64, n.sum(), dtype=np.uint64)
    want = [[sum(int(x) >> b & 1 for x in part) for b in range(64)] for part in np.split(h, np.cumsum(n)[:-1])]
    assert s.bit_counts(h, n).tolist() == want


def test_components(spark):
    edges = [(i + 1, i) for i in range(1, 200)] + [(1000 + i, 1000) for i in range(1, 500)] + [(-5, 7000), (3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 201)} | {1000 + i: 1000 for i in range(1, 500)} | {7000: -5}


@functools.lru_cache(None)
def fives(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    x, y = fives(a), fives(b)
    if min(len(x), len(y)) < 0.5 * max(len(x), len(y)):
        return 0.0  # less than a half, whatever it is
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def fp2(text):
    """128 bits of the text's two-word shingles, as two words, and the low ends of its four least hashes."""
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 2]) for i in range(len(w) - 1)] if len(w) >= 2 else w
    h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in sh], np.uint64)
    words = [h, s._more(h, 1)]
    return [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in k) > len(h)) if len(h) else 0 for k in words] + [[int(s._more(h, 16 + k).min()) & 0xFFFF if len(h) else 0 for k in range(4)]]


def components_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def confirmed_brute(docs):
    """Ids that stay. Candidates: an anchor in common, found by its definition (code words within 2 bits of
    a 31-bit block), the other word within FAR bits, and an equal least hash; links: similarity 0.8 inside a class of candidates."""
    docs = sorted(docs)
    n = len(docs)
    fps = [fp2(t) for _, t in docs]
    met = {}
    for i, f in enumerate(fps):
        for k in (0, 1):
            for half in (0, 1):
                block = f[k] >> 32 * half & 2**31 - 1
                syndrome = 0
                for b in range(31):
                    if block >> b & 1:
                        syndrome ^= b + 1
                flips = {0} if not syndrome else {1 << syndrome - 1} | {1 << a - 1 | 1 << (a ^ syndrome) - 1 for a in range(1, 32) if a ^ syndrome and a != syndrome}
                for x in flips:
                    met.setdefault((k, half, block ^ x), []).append(i)
    close = {(i, j) for (k, _, _), at in met.items() for a, i in enumerate(at) for j in at[a + 1 :] if (fps[i][1 - k] ^ fps[j][1 - k]).bit_count() <= s.FAR and any(map(int.__eq__, fps[i][2], fps[j][2]))}
    same = components_of(n, close)
    classes = {}
    for i, r in enumerate(same):
        classes.setdefault(r, []).append(i)
    links = [(i, j) for c in classes.values() for a, i in enumerate(c) for j in c[a + 1 :] if jaccard(docs[i][1], docs[j][1]) >= 0.8]
    return [docs[i][0] for i, r in enumerate(components_of(n, links)) if r == i]


def test_removed_documents_are_similar(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = confirmed_brute(texts.items())
    keep, s.BLOCK = s.BLOCK, 3
    try:
        split = sorted(r.doc_id for r in s.one_of_each(docs).collect())
    finally:
        s.BLOCK = keep
    assert split == want and sorted(r.doc_id for r in s.one_of_each(docs).collect()) == want
    gone = texts.keys() - set(want)
    assert not [k for k in gone if max(jaccard(texts[k], t) for x, t in texts.items() if x != k) < 0.8]
    ids = sorted(texts)
    links = [(i, j) for i, a in enumerate(ids) for j in range(i + 1, len(ids)) if jaccard(texts[a], texts[ids[j]]) >= 0.8]
    exact = {ids[i] for i, r in enumerate(components_of(len(ids), links)) if r != i}
    assert gone <= exact and len(gone) >= 0.95 * len(exact)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 999), st.integers(1, 40))
def test_similar_links_give_the_classes_of_all_pairs(seed, n):
    rng = np.random.default_rng(seed)
    base = [[f"w{x}" for x in rng.integers(0, 500, 60)] for _ in range(2)]
    texts = ["", "a b", " A  b"]
    for _ in range(n):
        w = list(base[rng.integers(0, 2)][: rng.integers(3, 61)])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    got = s.similar_links(texts)
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    assert set(got) <= set(want) and components_of(len(texts), got) == components_of(len(texts), want) and len(got) < len(texts)


def near_family(n, seed):
    """Copies of one passage with up to eight words changed: a hot class of near-duplicates."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    out = []
    for i in range(n):
        w = list(base)
        for k in range(rng.integers(0, 8)):
            w[rng.integers(0, 150)] = f"c{i}x{k}"
        out.append(" ".join(w))
    return out


def test_hot_family(spark):
    texts = near_family(3000, 8)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {r.doc_id for r in s.one_of_each(df).collect()}
    links = s.similar_links(texts)
    exact = {i for i, r in enumerate(components_of(len(texts), links)) if r == i}
    assert exact <= got and len(got) <= len(exact) + 0.05 * (len(texts) - len(exact))


def test_a_very_large_family_writes_few_rows(spark, monkeypatch):
    """Beyond BLOCKS blocks texts are dealt by least hashes: the same classes as from all pairs, and a bounded number of rows a text."""
    monkeypatch.setattr(s, "BLOCK", 64)
    texts = near_family(1500, 9)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    links = s.similar_links(texts)
    exact = components_of(len(texts), links)
    base = df.select(s.F.col("doc_id").alias("__row"), s.F.col("text").alias("__text"))
    rooted = df.select(s.F.col("doc_id").alias("row"), s.F.length("text").cast("long").alias("size"), s.F.lit(0).cast("long").alias("root"))
    dealt = s.comparisons(base, rooted, s.WORDS)
    rows = dealt.groupBy("row").count().agg(s.F.sum("count"), s.F.count("*")).first()
    groups = dealt.groupBy("root", "i", "j").count().agg(s.F.max("count")).first()[0]
    assert rows[0] <= (s.PASSES * (1 + 2 * s.REFS / s.BLOCK) + 1) * rows[1] and groups < 3 * s.BLOCK
    met = dealt.join(base.withColumnRenamed("__row", "row"), "row").select("root", "i", "j", "row", "__text").sortWithinPartitions("root", "i", "j")
    found = [(r.a, r.b) for r in met.repartition(4, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(s._confirm(s.WORDS, s.LEAST), "a long, b long").collect()]
    assert set(map(tuple, map(sorted, found))) <= {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if exact[i] == exact[j]}
    got = components_of(len(texts), found)
    apart = sum(r == i for i, r in enumerate(got)) - sum(r == i for i, r in enumerate(exact))
    assert 0 <= apart <= 0.01 * len(texts)


def test_a_very_large_class_loses_no_link(spark, monkeypatch):
    """Blocks of two texts, one pass, none in every block: most pairs do not meet, and still the classes are those of all pairs, also of texts outside
    of the largest tree that link to each other only."""
    monkeypatch.setattr(s, "BLOCK", 2)
    monkeypatch.setattr(s, "PASSES", 1)
    monkeypatch.setattr(s, "REFS", 0)
    texts = near_family(60, 12) + near_family(25, 13) + [f"lone{i} " + " ".join(f"z{i}x{k}" for k in range(40)) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    base = s.materialize(df.select(s.F.col("doc_id").alias("__row"), s.F.col("text").alias("__text")), "texts")
    monkeypatch.setattr(s, "candidate_roots", lambda best, far: best.select("row", s.F.lit(0).cast("long").alias("root")))
    best = base.select(s.F.col("__row").alias("row"), s.F.length("__text").cast("long").alias("size"))
    got = {r.row: r.root for r in s._confirmed_roots(base, best, s.FAR, s.WORDS, s.LEAST).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    assert [got.get(i, i) for i in range(len(texts))] == components_of(len(texts), links)


def test_similar_links_of_the_first_texts():
    texts = near_family(30, 14)
    got = s.similar_links(texts, first=4)
    want = [(i, j) for i in range(4) for j in range(i + 1, 30) if jaccard(texts[i], texts[j]) >= 0.8]
    assert components_of(30, got) == components_of(30, want) and want
