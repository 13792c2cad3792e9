import collections
import math
import random
import re

from tallyloom.llm import quality as q

D = "/root/testdata/sf0.001"


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = collections.Counter(zip(w, w[1:], w[2:]))
    c = [0] * len(w)
    for i in range(len(w) - 2):
        if g[w[i], w[i + 1], w[i + 2]] > 1:
            c[i] = c[i + 1] = c[i + 2] = 1
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(c)


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").collect() if r.quality == 1}
    out = q.op10_distribution_divergence(spark, D).collect()
    assert {r.doc_id for r in out} == set(texts) and len(out) == len(texts)
    for r in out:
        want = brute(texts[r.doc_id])
        assert tuple(r[c] for c in COLS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in good and not r.base_failed:
            assert r.kept


def test_edges(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x\n\nx\n \nx\r\nx", "é\U0001f600 ñ\x1cz <|>", "one two", "w " * 20001, "l\n" * 500, "a b c\n" * 3 + "é"]
    df = spark.createDataFrame([(i % 6, t, None, "p", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, words string, hits int")
    out = sorted(tuple(r[c] for c in COLS) for r in q.quality(df).collect())
    assert out == sorted(map(brute, texts))
    assert q.quality(df.drop("lang")).count() == len(texts)
    assert q.quality(df.limit(0)).count() == 0


def plain_distance(counts, shares):
    n = sum(counts)
    p = [x / n for x in counts]
    m = [(a + b) / 2 for a, b in zip(p, shares)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    return math.sqrt(max(0, (kl(p) + kl(shares)) / 2))


def test_divergence(spark):
    d = [([3, 1, 0], [0.5, 0.25, 0.25]), ([0, 0, 0], [0.5, 0.25, 0.25]), ([2, 1, 1], [0.5, 0.25, 0.25]), ([0, 0, 5], [0.5, 0.5, 0.0]), ([1, 1, 1], None)]
    df = spark.createDataFrame([(i, c, sum(c), r) for i, (c, r) in enumerate(d)], "i int, c array<long>, c_n long, r array<double>")
    for row in df.withColumn("d", q.js_distance("c", "r")).orderBy("i").collect():
        if not sum(row.c) or row.r is None:
            assert row.d is None
        else:
            assert abs(row.d - plain_distance(row.c, row.r)) < 1e-9


def test_verdicts_against_plain_counts(spark):
    """Common words, references, distances and verdicts of the whole table, recomputed."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: (r.lang, r.text or "", *brute(r.text)) for r in docs.collect()}
    plain = {k: re.findall(r"[^\W_]+", t.lower()) for k, (_, t, *_) in rows.items()}
    failed = {k: r[2] < 50 or 100 * r[6] > 50 * r[2] for k, r in rows.items()}
    words = {}
    for lang in {r[0] for r in rows.values()}:
        seen = collections.Counter(w for k, r in rows.items() if r[0] == lang and r[2] >= 50 for w in set(plain[k]))
        if seen and max(seen.values()) >= q.LEAST_TEXTS:
            words[lang] = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: q.COMMON]]
    assert {r.lang: list(r.common) for r in q.common_words(docs).collect()} == words and "the" in words["en"]
    hist = {}
    for k, r in rows.items():
        if r[0] in words:
            c = collections.Counter(plain[k])
            hist[k] = [c[w] for w in words[r[0]]] + [len(plain[k]) - sum(c[w] for w in words[r[0]])]
    total = {lang: [sum(x) for x in zip(*[h for k, h in hist.items() if rows[k][0] == lang and not failed[k]])] for lang in words}
    shares = {lang: [x / sum(t) for x in t] for lang, t in total.items()}
    for r in q.quality(docs).collect():
        if r.doc_id in hist and sum(hist[r.doc_id]):
            assert abs(r.word_distance - plain_distance(hist[r.doc_id], shares[r.lang])) < 1e-9
        else:
            assert r.word_distance is None
        assert r.kept == (not failed[r.doc_id] and not (r.word_chars >= 200 and r.char_distance > q.MAX_CHARS) and not (r.n_words >= 100 and (r.word_distance or 0) > q.MAX_WORDS))


def test_languages_without_a_reference_are_judged_by_classes(spark):
    rng = random.Random(2)
    say = lambda ws, n: " ".join(rng.choice(ws) + rng.choice(["", "", ",", "."]) for _ in range(n))
    english = "the of and to a in is it for as was with on at from by".split() + [f"word{i}" for i in range(30)]
    russian = "и в не на что он как это по из у за от так бы но".split() + [f"слово{chr(0x430 + i)}" for i in range(30)]
    rows = [(i, say(english, 150), "en") for i in range(30)] + [(100 + i, say(russian, 150), "ru") for i in range(25)]
    rows += [(200, say(russian, 150), "be"), (201, say(russian, 150), None), (300, say([f"x{i}" for i in range(90)], 150), "en")]
    out = {r.doc_id: r for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {k for k, r in out.items() if not r.kept} == {300}
    assert out[200].word_distance is None and out[201].word_distance is None and out[100].word_distance < 0.2


def test_junk_goes_and_prose_stays(spark):
    prose = ["The cat of the house was in the garden and it is as old as the tree that we planted for it with care. " + " ".join(f"Word{i} the field{i} of stone{i}" for i in range(k, k + 40)) for k in range(20)]
    junk = [" ".join(f"x{i}$$$ y{i}%%% |||" for i in range(k, k + 60)) for k in range(3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in q.quality(df).filter("kept").collect()}
    assert kept == set(range(20))
    common = spark.createDataFrame([("en", ["the"])], "lang string, common array<string>")
    refs = spark.createDataFrame([("en", [0.5] * 7, [0.5, 0.5])], "lang string, chars_share array<double>, hits_share array<double>")
    plan = q.judged(q.base_columns(df, common), refs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_every_language_may_have_a_reference(spark):
    """With the limits open a language of two texts is judged by its own words; a limit of one leaves the largest."""
    rng = random.Random(1)
    say = lambda c: " ".join(rng.choice([f"{c}{chr(97 + k)}" for k in range(20)]) for _ in range(160))
    rows = [(i, say("a"), "aa") for i in range(3)] + [(10 + i, say("b"), "bb") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert q.common_words(df).count() == 0 and [r.lang for r in q.common_words(df, 1, 1).collect()] == ["aa"]
    assert sorted(r.lang for r in q.common_words(df, 1, None).collect()) == ["aa", "bb"]
    out = q.quality(df, 1, None).collect()
    assert len(out) == 5 and all(r.word_distance is not None and r.word_distance < 0.3 for r in out)
    assert all(r.word_distance is None for r in q.quality(df).collect())
