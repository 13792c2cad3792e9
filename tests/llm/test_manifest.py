import hashlib
import random
import zlib

import pytest

from tallyloom.llm import manifest

D = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, fan):
    """All levels from the nodes to the one on top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def brute(rows, fan=16, changed=lambda row: row[4]):
    """rows: (doc_id, source, lang, n_chars, text). One tree a source, one above, proofs node by node."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r, leaf(r), leaf((*r[:4], changed(r)))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    own = {s: climb([x[1] for x in trees[s]], fan) for s in order}
    top = climb([own[s][-1][0] for s in order], fan)
    out = []
    for k, s in enumerate(order):
        for i, (r, mine, now) in enumerate(trees[s]):
            proof, cur = [], now
            for levels, at in ((own[s], i), (top, k)):
                for nodes in levels[:-1]:
                    run, p = nodes[at // fan * fan : at // fan * fan + fan], at % fan
                    proof += run[:p] + run[p + 1 :]
                    cur = sha(*run[:p], cur, *run[p + 1 :])
                    at //= fan
            out.append((str(r[0]), mine, own[s][-1][0], top[-1][0], sha(*proof), cur, cur == top[-1][0]))
    return sorted(out)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def lowered(row):
    """What the query does to a text."""
    text = row[4]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else text


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select(*manifest.COLUMNS).collect()]
    out = got(manifest.op13_subtree_exchange(spark, D))
    assert out == brute(rows, changed=lowered) and {r[-1] for r in out} == {True, False} and len({r[3] for r in out}) == 1


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, number int, digest binary"


def made(n, sources, rng):
    rows = []
    for i in range(n):
        s = rng.choice(sources)
        rows.append((rng.choice([None, i, i, i, 7]), s, rng.choice([None, "en", ""]), rng.choice([None, 3]), rng.choice([None, "", f"Text {i}", "Same É"])))
    return rows + rows[:5]


@pytest.mark.parametrize("fan, levels, n, sources", [(2, 1, 90, ["a", "b", None, "é", ""]), (2, 2, 60, [str(i) for i in range(40)]), (3, 1, 40, ["x"]), (16, 3, 300, [None, "-", ":", "Z", "\U0001f600", "�"])])
def test_many_tiers_nulls_and_ties(spark, fan, levels, n, sources):
    """Small superblocks: several tiers in the sources' trees and in the tree above; null and repeated ids, columns that clash."""
    rows = made(n, sources, random.Random(n))
    df = spark.createDataFrame([(*r, "t", 1, b"d") for r in rows], SCHEMA).repartition(3)
    text = manifest.F.col("text")
    changed = manifest.F.when(text.startswith("Text"), manifest.lower_ascii(text))
    out = got(manifest.manifest(df, changed, manifest.Shape(fan, levels)))
    assert out == brute(rows, fan, lambda r: r[4].lower() if (r[4] or "").startswith("Text") else r[4])


def test_two_tiers_of_full_size(spark):
    """One source beyond a superblock of 4,096 leaves."""
    df = spark.range(4200).selectExpr("id doc_id", "'s' source", "'en' lang", "1L n_chars", "repeat('x', cast(id % 3 as int)) text")
    rows = [(i, "s", "en", 1, "x" * (i % 3)) for i in range(4200)]
    assert got(manifest.manifest(df)) == brute(rows)


def test_none_one_and_long(spark):
    df = spark.createDataFrame([(1, "s", None, None, "É" * 2_000_000, None, None, None)], SCHEMA)
    assert manifest.manifest(df.limit(0)).count() == 0
    (r,) = got(manifest.manifest(df, manifest.lower_ascii(manifest.F.col("text"))))
    one = leaf((1, "s", None, None, "É" * 2_000_000))
    assert r == ("1", one, one, one, sha(), one, True)
