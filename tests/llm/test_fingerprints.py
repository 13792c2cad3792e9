import collections
import hashlib

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import fingerprints as fp

D = "/root/testdata/sf0.001"


def plain_units(text):
    """Split at newlines and at white space after a mark, then every 64 characters; blank parts go."""
    parts, part = [], ""
    for i, c in enumerate(text):
        if c == "\n" or (c.isspace() and i and text[i - 1] in ".!?;:,"):
            parts.append(part)
            part = ""
        else:
            part += c
    out = []
    for p in (x.strip() for x in [*parts, part]):
        out += [p[i : i + 64] for i in range(0, len(p), 64)]
    return out


def plain_digests(text):
    """Counter of (unit's digest); repeat k of a unit is hashed with seed k."""
    seen, out = collections.Counter(), []
    for u in plain_units(text):
        out.append(xxhash.xxh64_intdigest(u, seen[u]))
        seen[u] += 1
    return out


def plain_sketch(keys):
    """Cells of three tables of eight: counts, XOR of digests, upper half of the XOR of check hashes."""
    m = 2**64 - 1

    def mix(x, seed):
        x = ((x ^ x >> 31) * seed) & m
        return x ^ x >> 29

    cells = [[0, 0, 0] for _ in range(24)]
    for k in keys:
        for i, seed in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            c = cells[(mix(k, seed) >> 20) % 8 + 8 * i]
            c[0], c[1], c[2] = c[0] + 1, c[1] ^ k, c[2] ^ mix(k, 0xD6E8FEB86659FD93)
    return b"".join([(c[0] & 0xFFFF).to_bytes(2, "little") for c in cells] + [c[1].to_bytes(8, "little") for c in cells] + [(c[2] >> 32).to_bytes(4, "little") for c in cells]).hex()


def brute(docs):
    """Nothing of the module: likeness is the shared part of the multisets of digests."""
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(docs):
        t, u = t or "", docs[(i + 1) % len(docs)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        a, b, c = (collections.Counter(plain_digests(x)) for x in (t, e, u))
        near = lambda x, y: 1.0 if not x and not y else 1 - ((x - y).total() + (y - x).total()) / (x.total() + y.total())
        out.append((str(k), len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(a, b), 9), round(near(a, c), 9), plain_sketch(a.elements()), plain_sketch(b.elements())))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), r.fingerprint, r.edited_fingerprint) for r in df.collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    rows = got(fp.op9_lookup_sketch(spark, D))
    assert rows == brute(docs)
    long = [r for r in rows if r[1] > 300]
    assert sum(r[3] for r in long) / len(long) > 0.4 > 0.05 > sum(r[4] for r in long) / len(long)


def test_edges(spark):
    schema = "doc_id long, text string, part string, guest string"
    docs = [(5, "a b. c"), (5, "a b. c"), (None, "n"), (1, None), (2, ""), (3, "x" * 50000), (4, "é\n\U0001f600\n" * 300), (-9, "z")]
    assert got(fp.fingerprint_edits(spark.createDataFrame([(*d, "p", "g") for d in docs], schema))) == brute(docs)
    assert got(fp.fingerprint_edits(spark.createDataFrame([(7, "one. two", "p", "g")], schema))) == brute([(7, "one. two")])
    assert fp.fingerprint_edits(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_difference_recovers_digests(shared, a, b):
    a, b = a - shared, b - shared - a
    x, y = fp.difference(np.array(sorted(shared | a), np.uint64), np.array(sorted(shared | b), np.uint64))
    assert set(x.tolist()) == a and set(y.tolist()) == b


def test_digests_that_never_peel_come_to_an_end():
    a, b = np.array([5, 5, 9, 9, 9, 1], np.uint64), np.array([9, 1, 7, 7], np.uint64)
    x, y = fp.difference(a, b)
    assert sorted(x.tolist()) == [5, 5, 9, 9] and sorted(y.tolist()) == [7, 7] and fp.likeness(a, b) == 0.4
