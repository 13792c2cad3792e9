import math
import time
import unicodedata
import zlib

import numpy as np
import pytest

from tallyloom.llm import toxicity as t

D = "/root/testdata/sf0.01"


def test_fold():
    assert t.fold("You ID1OT!!") == " you idiot "
    assert t.fold("mоrоn, stυpid ＳＣＵＭ") == " moron stupid scum "
    assert t.fold("l0ser $tup1d 2024 3.14") == " loser stupid 2024 3 14 "
    assert t.fold("tr​ash") == " trash " and t.fold("") == "  "


def plain_fold(text):
    """The folding by splitting, character by character."""
    low = "".join(t.LOOKALIKES.get(ord(c), "" if ord(c) in t.INVISIBLE else c) for c in unicodedata.normalize("NFKC", text).lower())
    out, run = [], ""
    for c in low + "\n":
        if c.isalnum() or c in "_@$!":
            run += c
            continue
        core = run.rstrip("!")
        if any(x in t.SIGNS for x in core) and any(x.isalpha() for x in core):
            core = "".join(t.SIGNS.get(x, x) for x in core)
        out += [core, " " if core != run else "", c]
        run = ""
    return [w for w in "".join(x if x.isalnum() else " " for x in "".join(out)).split()]


def plain_score(model, text):
    """Without the automaton: every term and phrase is looked for at the beginning of every word."""
    words = plain_fold(text or "")
    line = " " + " ".join(words) + " " if words else "  "
    starts = [i for i in range(len(line) - 1) if line[i] == " "]
    found = {}
    for i in starts:
        w = max((v for k, v in model.terms.items() if line.startswith(k, i) and t.fold(k) not in map(t.fold, model.exceptions)), default=0)
        if w > 0:
            found[i] = w
    for e in map(t.fold, model.exceptions):
        at = line.find(e)
        while at >= 0:
            for k in [k for k in found if at <= k < at + len(e) - 1]:
                del found[k]
            at = line.find(e, at + 1)
    best = {}
    for i, w in found.items():
        key = line[i : line.index(" ", i + 1)]
        best[key] = max(w, best.get(key, 0))
    top = sorted(best.values(), reverse=True)[:3]
    n = max(len(words), 1)
    x = [top[0] if top else 0, sum(top), math.log(1 + sum(found.values())), math.log(1 + 100 * sum(found.values()) / n), math.sqrt(min(1, len(found) / n)), 1]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.coefficients, x))))


def test_whole_table_against_a_plain_scorer(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = t.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r.score for r in t.op4_toxicity_lexicon(spark, d).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(m.terms) > 20 and got.keys() == texts.keys()
    for k, text in texts.items():
        assert got[k] == pytest.approx(plain_score(m, text), abs=1e-9), k


def test_junk_takes_linear_time():
    began = time.perf_counter()
    for text in ("!" * 1_000_000, " " * 1_000_000, "a!" * 500_000, "!a1" * 300_000, "\u200b" * 1_000_000):
        t.fold(text)
    assert time.perf_counter() - began < 5


def test_exceptions_take_linear_time():
    """Many exception phrases beside many hits; stretches that touch and overlap."""
    m = t.Model({" trash ": 2.0, " moron ": 3.0, " idiot ": 3.0})
    began = time.perf_counter()
    found, n = t.hits(m.automaton(), t.fold("trash can moron idiot " * 50_000))
    assert (len(found), n) == (100_000, 200_000) and set(found.values()) == {3.0}
    assert time.perf_counter() - began < 3
    m = t.Model({" trash ": 2.0, " can ": 1.0, " bin ": 1.5}, exceptions=("trash can", "can bin"))
    assert list(t.hits(m.automaton(), t.fold("trash can bin bin trash trash can"))[0].values()) == [1.5, 2.0]


def test_exceptions_win_over_terms_of_the_same_text():
    m = t.Model({" clownfish ": 2.0, " clown": 1.0})
    assert list(t.hits(m.automaton(), t.fold("a clownfish and a clown"))[0].values()) == [1.0]


def test_exceptions_and_weights():
    m = t.Model({" trash ": 2.0, " trash": 1.5, " idiot": 3.0}, coefficients=(1.0, 0, 0, 0, 0, -2.0))
    a = m.automaton()
    assert t.hits(a, t.fold("put it in the trash can")) == ({}, 6)
    assert sorted(t.hits(a, t.fold("trash idiots trash can"))[0].values()) == [2.0, 3.0]
    s = t.score_texts(m, ["idiot", None, "clean words", "trash can"])
    assert s[0] > 0.7 and s[1] == s[2] == s[3] < 0.2
    assert t.score_texts(t.Model(), ["idiot", None]) == [0.0, 0.0]


def test_held_out_accuracy(spark):
    out = t.op4_toxicity_lexicon(spark, D)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{D}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(a and b for a, b in test)
    assert hit >= 0.6 * sum(a for a, _ in test) and hit >= 0.8 * sum(b for _, b in test)


def test_edges(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 3 else "you utter moron", i) for i in range(300)] + [(1000, None, 1), (1001, "", 1), (1001, "", 1), (None, "moron " * 50000, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)] + [(5, None, 1), (None, 1, 1), (6, 1, 1)], "doc_id long, toxic int, text int")
    m = t.train(docs, labels)
    assert t.train(docs, labels, None).terms == m.terms and len(t.train(docs, labels, 2).terms) == 2
    got = {r.doc_id: r.s for r in docs.select("doc_id", t.scorer(m)("text").alias("s")).collect()}
    assert got[3] > 0.9 > 0.1 > got[4] and got[1000] == got[1001] < 0.1 and got[None] >= 0.3
    assert t.train(docs.limit(0), labels).terms == {} and t.train(docs, labels.limit(0)).coefficients is None


def test_fit_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < t.logistic(x @ [1.5, -2.0] + 0.5)).astype(float)
    assert t.fit_logistic(x, y) == pytest.approx([1.5, -2.0, 0.5], abs=0.25)
