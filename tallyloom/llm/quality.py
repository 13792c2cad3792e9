"""Quality rules with distribution divergence (operator 10). Native: built-in functions only.

Base rules: fewer than 50 words, or more than half of the words inside repeated 3-word windows.

Method: two histograms of a text are held against language references by Jensen-Shannon
distance (base 2, so 0 to 1): shares of character classes, and shares of common words (and of
all other words). Words are lower-cased runs of letters and digits here, so marks do not count.
The references are measured on the whole corpus, for each ``lang``: its ``COMMON`` words that most of its
texts of 50 words or more have (document counts, in partial sums), then the counts of classes and of
these words, added up over all documents that pass the base rules. A language has a reference when a
word of it is in ``LEAST_TEXTS`` texts; there are at most ``LANGUAGES``, those of the most texts; both are parameters of ``quality``. A text
is held against the reference of its ``lang``. One whose lang is null or has no reference is judged by
classes alone, against the whole corpus. It fails when the class distance exceeds ``MAX_CHARS``, or the word distance
exceeds ``MAX_WORDS``. Guards: texts with fewer than ``MIN_CHARS`` word characters are not judged by
classes, texts with fewer than ``MIN_WORDS`` words are not judged by words.

All per-text work is in-row array expressions, so a row needs no shuffle; the texts are read
twice, for the common words and for the counts. Repeated windows
are found by sorting a text's window hashes with their positions (n log n in its words).
Two windows are the same when their 64-bit hashes are.

Results: a null text has no words and is not kept. Repeated rows and equal doc_ids are judged
each on its own. An empty table gives no rows. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, materialize, read, text_of

MIN_WORDS_BASE = 50
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHARS = 0.25
MAX_WORDS = 0.3
COMMON = 16
LEAST_TEXTS = 20
LANGUAGES = 1000

#: Character classes, as regular-expression sets; what none holds is class ``other``.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"\x20\x09-\x0D", "mark": r".,;:!?'\"()\-", "symbol": r"#*$%&|<>@^~_=+/\\\[\]{}`"}

#: What a word is for the histograms.
LETTERS = r"[\p{L}\p{M}\p{N}]+"


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def windows_of(words: Column) -> Column:
    """64-bit hashes of a text's 3-word windows, in order."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def sorted_windows(windows: Column) -> Column:
    """(hash, position) of a text's windows in order; empty where no hash repeats."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_positions(pairs: str) -> Column:
    """Positions of windows that occur at least twice: those whose neighbour in the column
    ``pairs`` has the same hash."""
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(pairs, lambda x, k: same(x, F.get(pairs, k - 1)) | same(x, F.get(pairs, k + 1)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def class_count(name: str) -> Column:
    """Characters of a class in ``text``. Most are lower-case letters: those go in one pass, and what is left (``rest``) is looked through for
    the other classes."""
    return (F.length("text") - F.length("rest") if name == "lower" else F.regexp_count("rest", F.lit(f"[{CLASSES[name]}]"))).cast("long")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text); lang is null where there is no such column."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_of().alias("text"))


def plain_words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), 0)


def common_words(docs: DataFrame, least_texts: int = LEAST_TEXTS, languages: int | None = LANGUAGES) -> DataFrame:
    """(lang, common): the words that are in most texts of each language with a reference, in falling order. Without a limit of
    ``languages`` all are kept."""
    long = _texts(docs).filter(F.col("lang").isNotNull() & (F.regexp_count("text", F.lit(WORD)) >= MIN_WORDS_BASE))
    seen = long.select("lang", F.explode(F.array_distinct(plain_words("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # COMMON rows a task and language
    top = seen.withColumn("k", rank).filter(F.col("k") <= COMMON)
    listed = top.groupBy("lang").agg(F.max("n").alias("most"), F.sort_array(F.collect_list(F.struct("k", "word")))["word"].alias("common"))
    enough = listed.filter(F.col("most") >= least_texts)
    return (enough if languages is None else enough.orderBy(F.desc("most"), "lang").limit(languages)).select("lang", "common")


def _side(df: DataFrame, languages: int | None) -> DataFrame:
    """A table of a row a language: broadcast where their number is bounded, else joined as Spark sees fit."""
    return df if languages is None else F.broadcast(df)


def base_columns(docs: DataFrame, common: DataFrame, languages: int | None = LANGUAGES) -> DataFrame:
    """doc_id, lang, the base columns, and the histograms ``chars`` (CLASSES, other) and ``hits`` (the common
    words of the text's language, other; null without a reference).

    Each select names what the next one uses several times, so nothing is computed twice; an
    array that a lambda looks into is always a column, else it would be built for each element."""
    lists = common.withColumn("longest", F.array_max(F.transform("common", lambda w: F.length(w))))
    a = _texts(docs).withColumn("rest", F.regexp_replace("text", f"[{CLASSES['lower']}]+", "")).join(_side(lists, languages), "lang", "left")
    b = a.select(
        "doc_id", "lang", "common", "longest", F.length("text").cast("long").alias("n_chars"),
        F.regexp_count("rest", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.array(*map(class_count, CLASSES)).alias("classes"),
        F.when(F.col("common").isNotNull(), plain_words("text")).alias("plain"),
    )
    c = b.select(
        "doc_id", "lang", "common", "n_chars", "n_symbols", "words", "classes",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows_of(F.col("words")).alias("windows"),
        F.size("plain").cast("long").alias("n_plain"),
        F.filter("plain", lambda w: (F.length(w) <= F.col("longest")) & F.array_contains("common", w)).alias("found"),
    )
    d = c.withColumn("pairs", sorted_windows(F.col("windows"))).drop("windows")
    d = d.withColumn("at", repeated_positions("pairs")).drop("pairs")
    n = F.size("words").cast("long")
    hits = F.transform("common", lambda w: F.size(F.filter("found", lambda x: x == w)).cast("long"))
    return d.select(
        "doc_id", "lang", n.alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        total(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get("at", k - 1), F.lit(3))))).alias("n_repeat_words"),
        F.concat("classes", F.array(F.greatest(F.col("n_chars") - total(F.col("classes")), F.lit(0).cast("long")))).alias("chars"),
        F.concat(hits, F.array(F.col("n_plain") - F.size("found"))).alias("hits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS_BASE) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _sums(name: str, n: int) -> Column:
    return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)]).alias(name)


def _shares(name: str) -> Column:
    return F.transform(name, lambda x: F.coalesce(F.try_divide(x, F.aggregate(name, F.lit(0).cast("bigint"), lambda a, y: a + y)), F.lit(0.0))).alias(f"{name}_share")


def references(counts: DataFrame) -> DataFrame:
    """(lang, chars_share, hits_share): shares of the character classes and common words over all texts that pass
    the base rules; at most LANGUAGES rows. The row of lang null is that of the whole corpus."""
    good = counts.filter(~base_failed())
    named = F.when(F.col("hits").isNotNull(), F.col("lang"))
    by = good.withColumn("lang", named).groupBy("lang").agg(_sums("chars", len(CLASSES) + 1), _sums("hits", COMMON + 1))
    parts = materialize(by, "quality_sums")
    every = parts.agg(_sums("chars", len(CLASSES) + 1)).select(F.lit(None).cast("string").alias("lang"), "chars", F.lit(None).cast("array<bigint>").alias("hits"))
    both = parts.filter("lang IS NOT NULL").select("lang", "chars", F.filter("hits", lambda x: x.isNotNull()).alias("hits")).unionByName(every)
    return both.select("lang", _shares("chars"), _shares("hits"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def js_distance(counts: str, shares: str) -> Column:
    """Jensen-Shannon distance (base 2) of the histogram in column ``counts``, with its sum in ``counts``_n, to
    the known ``shares``; null where the sum is 0 or there are no shares."""
    n = F.col(f"{counts}_n")
    term = lambda c, q: (_xlogx(F.try_divide(c, n)) + _xlogx(q)) / 2 - _xlogx((F.try_divide(c, n) + q) / 2)
    return F.when((n > 0) & F.col(shares).isNotNull(), F.sqrt(F.greatest(F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def judged(counts: DataFrame, refs: DataFrame, languages: int | None = LANGUAGES) -> DataFrame:
    """Adds char_distance, word_distance (null without a reference), base_failed and kept."""
    key = F.when(F.col("hits").isNotNull(), F.col("lang"))
    known = _side(refs.withColumnRenamed("lang", "__lang"), languages)
    df = counts.withColumn("__key", key).join(known, F.col("__key").eqNullSafe(F.col("__lang")), "left")
    df = df.withColumns({"chars_n": total(F.col("chars")), "hits_n": total(F.col("hits"))})
    df = df.withColumns({"char_distance": js_distance("chars", "chars_share"), "word_distance": js_distance("hits", "hits_share")})
    bad_chars = (F.col("word_chars") >= MIN_CHARS) & F.coalesce(F.col("char_distance") > MAX_CHARS, F.lit(False))
    bad_words = (F.col("n_words") >= MIN_WORDS) & F.coalesce(F.col("word_distance") > MAX_WORDS, F.lit(False))
    df = df.drop("__key", "__lang", "chars_n", "hits_n", "chars_share", "hits_share")
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad_chars & ~bad_words)


def quality(docs: DataFrame, least_texts: int = LEAST_TEXTS, languages: int | None = LANGUAGES) -> DataFrame:
    """All counts, distances and verdicts, a row per document. Counts are written, then summed into
    references and judged. ``languages=None`` gives every language a reference whose words are in ``least_texts`` texts, 1 for all."""
    common = materialize(common_words(docs, least_texts, languages), "common_words")
    counts = materialize(base_columns(docs, common, languages), "quality_counts")
    return judged(counts, materialize(references(counts), "references"), languages)


def op10_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op10_sql() -> str:
    """The query in DuckDB's SQL, built from the same classes and limits."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    word, has = q(WORD), "lambda x: regexp_matches(x, " + q(WORD) + ")"
    classes = ", ".join(f"len(regexp_extract_all(t, {q(f'[{c}]')}))" for c in CLASSES.values())
    term = "CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END / 2 - CASE WHEN p + q > 0 THEN (p + q) / 2 * log2((p + q) / 2) ELSE 0 END"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {word}) AS w, regexp_extract_all(lower(t), {q(LETTERS)}) AS plain, list_filter(string_split(t, chr(10)), {has}) AS lines FROM d),
df AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(plain)) AS word FROM w WHERE len(w) >= {MIN_WORDS_BASE} AND lang IS NOT NULL) GROUP BY lang, word),
r0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k, max(n) OVER (PARTITION BY lang) AS most FROM df),
r1 AS (SELECT *, dense_rank() OVER (ORDER BY most DESC, lang) AS place FROM r0 WHERE k <= {COMMON} AND most >= {LEAST_TEXTS}),
r AS (SELECT lang, word FROM r1 WHERE place <= {LANGUAGES}),
i AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM i),
p AS (SELECT rid, count(DISTINCT i + o) AS n FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY rid),
b AS (SELECT w.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS_BASE} OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{classes}] AS cs, CASE WHEN lang IN (SELECT lang FROM r) THEN lang END AS ref FROM b),
c0 AS (SELECT rid, ref, base_failed, unnest(range(0, {len(CLASSES) + 1})) AS bin, unnest(cs || [greatest(length(t) - list_sum(cs), 0)]) AS c FROM f),
c1 AS (SELECT *, sum(c) OVER (PARTITION BY rid) AS n FROM c0),
h0 AS (SELECT rid, ref, base_failed, word AS bin, len(list_filter(plain, lambda x: x = word)) AS c, len(plain) AS n FROM f JOIN r ON ref = r.lang),
h1 AS (SELECT * FROM h0 UNION ALL SELECT rid, ref, base_failed, '' AS bin, n - sum(c) AS c, n FROM h0 GROUP BY rid, ref, base_failed, n),
cr AS (SELECT ref, bin, CAST(sum(c) AS DOUBLE) / sum(sum(c)) OVER (PARTITION BY ref) AS q FROM c1 WHERE NOT base_failed AND ref IS NOT NULL GROUP BY ref, bin UNION ALL SELECT NULL, bin, CAST(sum(c) AS DOUBLE) / sum(sum(c)) OVER () AS q FROM c1 WHERE NOT base_failed GROUP BY bin),
hr AS (SELECT ref, bin, CAST(sum(c) AS DOUBLE) / sum(sum(c)) OVER (PARTITION BY ref) AS q FROM h1 WHERE NOT base_failed GROUP BY ref, bin),
terms AS (SELECT 'c' AS what, rid, CAST(c AS DOUBLE) / n AS p, q FROM c1 JOIN cr ON c1.bin = cr.bin AND c1.ref IS NOT DISTINCT FROM cr.ref WHERE n > 0 UNION ALL SELECT 'w', rid, CAST(c AS DOUBLE) / n, q FROM h1 JOIN hr ON h1.bin = hr.bin AND h1.ref = hr.ref WHERE n > 0),
m AS (SELECT rid, sqrt(greatest(sum({term}) FILTER (WHERE what = 'c'), 0)) AS cd, sqrt(greatest(sum({term}) FILTER (WHERE what = 'w'), 0)) AS wd FROM terms GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (word_chars >= {MIN_CHARS} AND coalesce(cd > {MAX_CHARS}, false)) AND NOT (n_words >= {MIN_WORDS} AND coalesce(wd > {MAX_WORDS}, false)) AS kept FROM f LEFT JOIN m USING (rid)"""


OP10_SQL = _op10_sql()
