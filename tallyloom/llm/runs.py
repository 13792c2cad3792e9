"""Runs of repeated words (operator 11), by branching tandem repeats in an enhanced suffix array.

A run is a longest stretch of words in which words ``period`` apart are equal, for its smallest period,
with at least ``times`` periods and ``least`` words. Each text is searched alone:

1. Suffixes are sorted by doubling: level k names the 2**k words from each position. Only suffixes that
   still share their name take part in the next level. The last level is the inverse suffix array (ISA).
2. Common prefixes of neighbours (LCP) follow from the names, from the longest step to the shortest.
3. An LCP interval holds the suffixes that share ``depth`` words; its bounds are the next smaller values
   on both sides, found for all intervals at once. No tree nodes are made: an interval is two bounds, its
   children lie between the places of its least value.
4. Branching test: for each suffix i of every child but the largest, i + depth and i - depth are looked up in
   ISA. If one is in the interval but in another child, the two differ after depth words, so that a square of
   that period ends its run there. All other children together hold n log n suffixes at most.
5. A square is rotated to the left as long as the words that come in and go out are equal, in steps of the
   levels; the stretch from there to the square's end is the run. Of equal stretches the smallest period
   counts (a period's multiples give the same stretch).

Texts are laid end to end in blocks of BLOCK words and sorted together, with the text before the word, so numpy
works on whole blocks and copies in a block cost no more than other texts. A row is one text and meets no
other, so there is no shuffle, no state, and a lost task is done again alone. Memory is about 8 bytes a word
and level for a block, or for one longer text; levels are the logarithm of the longest repeat.

Results: a null text is empty. An empty text, or one without a run, has an empty array of runs and keeps its words.
Rows are independent: repeated rows give repeated results, null ids stay null, an empty table gives no rows, further
columns are ignored. Words are split at ASCII white space alone, whatever else the text holds.
"""

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, read, text_of

#: Words of texts that are worked on at once.
BLOCK = 1 << 18
LEAST, TIMES = 6, 4
OUT = "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def suffix_names(ids: np.ndarray, text: np.ndarray, left: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(names, order, level): names[k] is equal for positions of a text exactly where the next 2**k words are; the last
    one is the inverse of ``order``, the sorted suffixes. ``level[s]``: the last level at which the suffix at s and the one
    before it had one name, -1 for none.

    ``text``: the number of each position's text, ascending; ``left``: words from there to the text's end."""
    n = len(ids)
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    head = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    slot = np.arange(n)
    first = np.maximum.accumulate(np.where(head, slot, 0))
    names = [np.empty(n, np.int64)]
    names[0][order] = first
    level = np.where(head, -1, 0)
    step = 1
    while True:
        head_after = np.concatenate((head[1:], [True]))
        live = np.flatnonzero(~(head & head_after))
        if not len(live):
            return names, order, level
        was = names[-1]
        p = order[live]
        more = left[p] > step
        second = np.where(more, was[np.minimum(p + step, n - 1)] + 1, 0)
        o = np.lexsort((second, was[p]))
        p, group, second = p[o], was[p[o]], second[o]
        order[live] = p
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        now = was.copy()
        now[p] = np.maximum.accumulate(np.where(fresh, live, 0))
        names.append(now)
        head[live] = fresh
        level[live[~fresh]] = len(names) - 1
        step *= 2


def common_prefixes(names: list[np.ndarray], order: np.ndarray, level: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Words that each sorted suffix shares with the one before it in the same text."""
    out = np.where(level >= 0, np.int64(1) << np.maximum(level, 0), 0)
    last = len(order) - 1
    for k in range(int(level.max(initial=-1)) - 1, -1, -1):
        s = np.flatnonzero(level > k)
        a, b, d = order[s - 1], order[s], out[s]
        same = (left[a] > d) & (left[b] > d) & (names[k][np.minimum(a + d, last)] == names[k][np.minimum(b + d, last)])
        out[s[same]] += 1 << k
    return out


def next_smaller(x: np.ndarray) -> np.ndarray:
    """The next place of a smaller value, for every place of a positive one; the last value must be 0.

    Places jump over what their target has jumped over, all at once."""
    to = np.arange(1, len(x) + 1)
    live = np.flatnonzero((x[:-1] > 0) & (x[1:] >= x[:-1]))
    while len(live):
        to[live] = to[to[live]]
        live = live[x[to[live]] >= x[live]]
    return to


def smaller_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(slot, depth, low, high, begin, end) of every suffix in a child of an LCP interval that is not its largest: the
    interval is [low, high), the child [begin, end)."""
    n = len(lcp)
    cut = np.flatnonzero(lcp > 0)
    high = next_smaller(np.append(lcp, 0))[cut]
    low = n - next_smaller(np.append(lcp[::-1], 0))[n - 1 - cut] - 1
    o = np.lexsort((cut, high, low))
    cut, low, high = cut[o], low[o], high[o]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(cut) else np.zeros(0, bool)
    ends = np.concatenate((np.where(new[1:], high[:-1], cut[1:]), high[-1:]))
    # a child begins at each place of the least value, and one at the interval's begin
    begin, end = np.concatenate((cut, low[new])), np.concatenate((ends, cut[new]))
    index = np.cumsum(new) - 1
    of = np.concatenate((index, np.arange(int(new.sum()))))
    depth, low, high = lcp[cut[new]][of], low[new][of], high[new][of]
    o = np.lexsort((begin, end - begin, of))
    largest = o[np.concatenate((of[o][1:] != of[o][:-1], [True]))] if len(o) else o
    keep = np.ones(len(of), bool)
    keep[largest] = False
    begin, end, depth, low, high = begin[keep], end[keep], depth[keep], low[keep], high[keep]
    size = end - begin
    child = np.repeat(np.arange(len(size)), size)
    slot = begin[child] + np.arange(len(child)) - (np.cumsum(size) - size)[child]
    return slot, depth[child], low[child], high[child], begin[child], end[child]


def runs_of(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in texts of ``sizes`` words laid end to end, by start, then period."""
    none = np.zeros(0, np.int64)
    n = len(ids)
    if not n:
        return none, none, none
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin, left = (ends - sizes)[text], ends[text] - np.arange(n)
    names, order, level = suffix_names(ids, text, left)
    lcp = common_prefixes(names, order, level, left)
    slot, depth, low, high, a, z = smaller_children(lcp)
    fits = depth * times <= sizes[text[order[slot]]]
    slot, depth, low, high, a, z = (x[fits] for x in (slot, depth, low, high, a, z))
    i, isa = order[slot], names[-1]
    found = []
    for j, inside, left_one in ((i + depth, depth < left[i], i), (i - depth, i - depth >= begin[i], i - depth)):
        at = isa[np.clip(j, 0, n - 1)]
        hit = inside & (low <= at) & (at < high) & ((at < a) | (at >= z))
        found.append(left_one[hit] * n + depth[hit])
    at, period = np.divmod(np.unique(np.concatenate(found)), n)
    start = at.copy()
    for k in range(len(names) - 2, -1, -1):
        to = start - (1 << k)
        back = np.maximum(to, 0)
        start = np.where((to >= begin[at]) & (names[k][back] == names[k][back + period]), to, start)
    end = at + 2 * period
    long = end - start >= np.maximum(least, times * period)
    start, end, period = start[long], end[long], period[long]
    o = np.lexsort((period, end, start))
    start, end, period = start[o], end[o], period[o]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(o) else np.zeros(0, bool)
    start, end, period = start[first], end[first], period[first]
    o = np.lexsort((period, start))
    return start[o], end[o], period[o]


def _blocks(docs: list, texts: list[bytes | None]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Runs of texts, split into words, of about BLOCK words; a longer text is one of its own."""
    held_docs, held, size = [], [], 0
    for doc, t in zip(docs, texts, strict=True):
        words = (t or b"").split()
        if held and size + len(words) > BLOCK:
            yield held_docs, held
            held_docs, held, size = [], [], 0
        held_docs.append(doc)
        held.append(words)
        size += len(words)
    if held:
        yield held_docs, held


def _search(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    fields = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct(fields))), ("collapsed", pa.string())])
    for b in batches:
        for docs, texts in _blocks(b.column(0).to_pylist(), b.column(1).to_pylist()):
            known: dict[bytes, int] = {}
            for t in texts:
                known.update(dict.fromkeys(t))
            known = {w: i for i, w in enumerate(known)}
            sizes = np.array([len(t) for t in texts])
            ids = np.fromiter((known[w] for t in texts for w in t), np.int64, int(sizes.sum()))
            start, end, period = runs_of(ids, sizes, least, times)
            gone = np.zeros(len(ids) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            kept = np.cumsum(gone[:-1]) == 0
            ends = np.cumsum(sizes)
            of = np.searchsorted(ends, start, "right")
            offsets = np.searchsorted(of, np.arange(len(texts) + 1))
            runs = pa.StructArray.from_arrays([pa.array(start - (ends - sizes)[of]), pa.array(end - start), pa.array(period)], fields=fields)
            collapsed = [b" ".join(t if offsets[i] == offsets[i + 1] else compress(t, kept[e - len(t) : e].tolist())) for i, (t, e) in enumerate(zip(texts, ends.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of each text by start, then period, and its words, joined by one space, without
    those that lie in a run after the run's first period."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return slim.mapInArrow(partial(_search, least=least, times=times), OUT)


def repeated_tail(text: Column, key: Column) -> Column:
    """The text for one key in ten with its words from word a on replaced by repetitions of the first p of these, as the query
    states; null keys and texts without words stay."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.element_at(words, (1 + F.when(i < a, i).otherwise(a + (i - a) % p)).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), " ")

    # as a lambda's argument the words are found once, not once a word
    tail = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), 0)), repeated), 0)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), tail).otherwise(text)


def op11_branching_tandems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text of ``documents``, one text in ten with a repeated tail; digests of the runs and of what is kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs.withColumn("text", repeated_tail(text_of(), F.col("doc_id"))))
    better = lambda x, y: (
        F.when(x["length"] * y["period"] != y["length"] * x["period"], F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).otherwise(1))
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .otherwise(F.signum(x["period"] - y["period"]).cast("int"))
    )
    best = F.try_element_at(F.array_sort("runs", better), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    shown = found.withColumn("best", best)
    return shown.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of a text's bytes in DuckDB's SQL: the table of 256 values follows from the polynomial.
CRC_SQL = """crc_bits AS (SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(b)),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_bits),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM (SELECT DISTINCT doc_id FROM documents), crc_table)"""

#: The query in DuckDB's SQL: pairs of equal words of a text, gathered into stretches by their distance.
OP11_SQL = rf"""WITH {CRC_SQL},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CAST(h AS BIGINT) AS h FROM documents LEFT JOIN crc USING (doc_id)),
e AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM d),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM e),
x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM t),
y AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
g AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM y) GROUP BY doc_id, q, k),
r AS (SELECT doc_id, s, e, min(q) AS q FROM g WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
o AS (SELECT a.* FROM r a WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.doc_id = a.doc_id AND ((z.e - z.s) * a.q > (a.e - a.s) * z.q OR ((z.e - z.s) * a.q = (a.e - a.s) * z.q AND (z.s < a.s OR (z.s = a.s AND z.q < a.q)))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS "start", CAST(e - s AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * (e - s) // q AS BIGINT) AS exponent_milli,
sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)"""
