"""Removal of word sequences that also start earlier (operator 12), by compressed FM-indexes of shards.

A window is SPAN consecutive words; each word is removed that a window covers whose words also start earlier. Plan:

1. Whole copies of an earlier text (equal SHA-256) go by aggregation; no group meets in a task.
2. Each window has an anchor: of the GRAM-word sequences in it the one with the least hash, the leftmost on ties. Equal windows have equal
   anchors at equal places, so the anchors' hashes deal windows to shards such that equal ones share a shard, and no document is
   held against a shard that it has nothing in common with. One shuffle by hash finds the hashes that repeat; each
   task keeps one row a hash.
3. Texts meet their repeated anchors (one shuffle by document) and give the pieces around them, of 20 to 32 words. Of equal pieces a
   task ships the first; the others are known to start earlier. One shuffle by hash.
4. A shard is a stretch of hashes with up to SORTED bytes of distinct pieces. Their words, compared as they are, make an FM-index (``fm_index``),
   with the earliest place of each interval of 20 words. The documents' pieces, but for the first at each
   anchor, are streamed through backward search; where matching statistics reach 20 words and the interval's earliest place is
   before the window's own, the window is reported.
   An anchor with over HOT bytes of distinct pieces (a short passage among very many different words) gives out its windows
   one by one, by a 128-bit digest; their firsts are minima, added up before the shuffle, so that such windows meet in no task.
5. Reported intervals meet their text (one shuffle by document) and their words are cut out.

Words are compared exactly, but for the windows of hot anchors; hashes only decide what is compared. A task holds some 150 bytes for a word of
its shard (2 MB to 8 MB of text) and some 60 bytes for a byte of the block at hand: BLOCK, or the longest text.

Results: a null text has no words. Documents are ordered by doc_id, nulls first. Repeated rows (equal doc_id and text) are one
document: all get its result. Rows that share a doc_id, or have none, but not the text are ordered by the text's SHA-256. Texts that differ in
white space alone are different documents with equal words. An empty table gives no rows. Extra columns are ignored.
"""

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Sink, arrow_schema, materialize, partitions, read
from tallyloom.llm.fm_index import FmIndex
from tallyloom.llm.repeats import _batch, _keyed, _match, _spread, _union

SPAN, GRAM = 20, 8
#: Bytes of text worked on at once; of distinct pieces in a shard; pieces remembered by a task; anchors gathered before a task gives them out.
BLOCK = 1 << 20
SORTED = 2 << 20
HOT = 8 << 20
REMEMBERED = 100_000
GATHERED = 1_000_000
_ANCHOR = "h long, key long, pos long"
_PIECE = "h long, key long, pos long, low int, high int, words binary"
_RAW = "key long, a long, z long, digest binary"
OUT = "doc_id long, n_words long, n_removed long, kept string"
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_ODD = [(0xD1B54A32D192ED03 * (2 * i + 1)) % 2**64 | 1 for i in range(GRAM)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def spell(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, last): the texts' words with one space after each, where each word starts and ends, and the
    number of words up to each text's end."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = _SPACES[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the space after a word
    kept = np.concatenate(([0], np.cumsum(keep)))
    raw, space = raw[keep], space[keep]
    ends = np.flatnonzero(space)
    starts = np.concatenate(([0], ends + 1))[: len(ends)]
    last = np.searchsorted(ends, kept[np.cumsum([len(t) + 1 for t in texts])])
    return np.where(space, np.uint8(32), raw), starts, ends, last


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed."""
    at = _powers(_BASE, len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * at)))
    h = (total[ends] - total[starts]) * _powers(pow(_BASE, -1, 2**64), len(raw))[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of the anchors of texts of hashed words laid end to end. Windows are named by their start
    and lie within one text."""
    none = np.zeros(0, np.int64)
    n = len(words) - SPAN + 1
    if n <= 0:
        return none, none, none, none
    m = len(words) - GRAM + 1
    h = np.zeros(m, np.uint64)
    for i, odd in enumerate(_ODD):
        h += words[i : i + m] * np.uint64(odd)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(32)
    least, size, offsets = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64), 1, SPAN - GRAM + 1
    while 2 * size <= offsets:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (offsets - size)], least[offsets - size :])
    begins = np.concatenate(([0], last[:-1]))
    ends = np.maximum(last - SPAN + 1, begins)  # a text's windows start in [begin, end)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, ends, -1)
    s = np.flatnonzero(np.cumsum(step)[:n] > 0)
    if not len(s):
        return none, none, none, none
    at = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    to = np.concatenate((first[1:] - 1, [len(s) - 1]))
    pos = at[first]
    return h[pos].view(np.int64), pos, s[first], s[to]


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of a batch's texts of about BLOCK bytes; a longer text is a run of its own."""
    texts = b.column(1).to_pylist()
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield slice(begin, i), texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts)), texts[begin:]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, key, pos): anchors to be matched; pos -1: the hash repeats in this task; -2 - pos: a decided anchor, dealt by place."""
    schema = arrow_schema(_ANCHOR)
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def give() -> Iterator[pa.RecordBatch]:
        h, key, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        o = np.argsort(h, kind="stable")
        h, key, pos = h[o], key[o], pos[o]
        head = np.concatenate(([True], h[1:] != h[:-1]))
        lone = head & np.concatenate((head[1:], [True]))
        twice, many = head & ~lone, ~lone
        out = (
            np.concatenate((h[lone], h[twice], _spread(key[many], pos[many]))),
            np.concatenate((key[lone], np.zeros(int(twice.sum()), np.int64), key[many])),
            np.concatenate((pos[lone], np.full(int(twice.sum()), -1), -2 - pos[many])),
        )
        for i in range(0, len(out[0]), 1 << 16):
            yield _batch(schema, *[c[i : i + (1 << 16)] for c in out])

    for b in batches:
        keys = b.column(0).to_numpy()
        for part, texts in _blocks(b):
            raw, starts, ends, last = spell(texts)
            h, pos, _, _ = anchors(word_hashes(raw, starts, ends), last)
            if len(h):
                at = np.searchsorted(last, pos, "right")
                held.append((h, keys[part][at], pos - np.concatenate(([0], last))[at]))
                count += len(h)
            if count >= GATHERED:
                yield from give()
                held, count = [], 0
    if held:
        yield from give()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces around the anchors at the given places; those equal to an earlier one of the task come back decided: h and
    words null. low to high: words before the anchor in its windows."""
    sink = Sink(arrow_schema(_PIECE), 1 << 14)
    seen: dict[tuple[bytes, int], tuple[int, int]] = {}
    for b in batches:
        keys, places = b.column(0).to_numpy(), b.column(2)
        flat, offsets = places.flatten().to_numpy(), places.offsets.to_numpy()
        for part, texts in _blocks(b):
            raw, starts, ends, last = spell(texts)
            h, pos, first, to = anchors(word_hashes(raw, starts, ends), last)
            begins = np.concatenate(([0], last[:-1]))
            many = np.diff(offsets[part.start : part.stop + 1])
            wanted = flat[offsets[part.start] : offsets[part.stop]] + np.repeat(begins, many)
            keep = np.isin(pos, wanted)
            h, pos, first, to = h[keep], pos[keep], first[keep], to[keep]
            at = np.searchsorted(last, pos, "right")
            buf = raw.tobytes()
            cols = (h, keys[part][at], pos - begins[at], pos - to, pos - first, starts[first], ends[to + SPAN - 1])
            for x, key, place, low, high, a, z in zip(*[c.tolist() for c in cols], strict=True):
                words, me = buf[a:z], (key, place)
                was = seen.get((words, high))
                if was is not None and was < me:
                    x = words = None
                else:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[words, high] = me
                if sink.add((x, key, place, low, high, words), z - a):
                    yield from sink.flush()
    yield from sink.flush()


def _later(pieces: dict[tuple, tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(key, a, z) of words covered by reported windows, in a shard of distinct pieces: (h, high, words) and the place of their anchor."""
    kept = sorted((h, key, pos - high, words) for (h, high, words), (key, pos) in pieces.items())
    streamed = np.flatnonzero([i > 0 and p[0] == kept[i - 1][0] for i, p in enumerate(kept)])
    if not len(streamed):
        return
    kept = [(key, begin, words.split(b" ")) for _, key, begin, words in kept]
    known: dict[bytes, int] = {}
    for p in kept:
        known.update(dict.fromkeys(p[2]))
    known = {w: i for i, w in enumerate(known)}
    sizes = np.array([len(p[2]) for p in kept])
    ids = np.fromiter((known[w] for p in kept for w in p[2]), np.int64, int(sizes.sum()))
    start = np.cumsum(sizes) - sizes
    key, begin = (np.array([p[i] for p in kept]) for i in range(2))
    _, order = np.unique(key, return_inverse=True)
    place = np.repeat((order << 40) + begin - start, sizes) + np.arange(len(ids))
    index = FmIndex(ids, sizes, place, SPAN)
    many = sizes[streamed]
    take = np.repeat(start[streamed] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    length, number = index.matching_statistics(ids[take], many)
    hit = length >= SPAN
    hit[hit] = index.first[number[hit]] < place[take][hit]
    own = take[hit]
    head = np.flatnonzero(np.concatenate(([True], np.diff(own) != 1))) if len(own) else own
    tail = np.concatenate((head[1:], [len(own)]))[: len(head)] - 1
    piece = np.searchsorted(start, own[head], "right") - 1
    a, z = begin[piece] + own[head] - start[piece], begin[piece] + own[tail] - start[piece] + SPAN
    yield from zip(key[piece].tolist(), a.tolist(), z.tolist(), strict=True)


def _windows(piece: tuple, place: tuple[int, int]) -> Iterator[tuple[int, int, int, bytes]]:
    """Every window of a piece, with its digest."""
    (_, high, words), (key, pos) = piece, place
    words = words.split(b" ")
    for i in range(len(words) - SPAN + 1):
        yield key, pos - high + i, pos - high + i + SPAN, xxhash.xxh128_digest(b" ".join(words[i : i + SPAN]))


def _search(batches: Iterator[pa.RecordBatch], most: int, step: int) -> Iterator[pa.RecordBatch]:
    """(key, a, z, digest): word ranges to remove; those with a digest are windows of hot anchors, to be decided. Rows come sorted by h,
    decided ones (h null) first."""
    sink = Sink(arrow_schema(_RAW), 1 << 16)
    held: dict[tuple, tuple[int, int]] = {}  # distinct pieces, the first place of each
    size = own = 0
    last = hot = None

    def ranges(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for r in found:
            if sink.add((*r, None)[:4]):
                yield from sink.flush()

    for b in batches:
        for h, key, pos, low, high, words in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if h is None:
                yield from ranges([(key, pos - high, pos - low + SPAN)])
                continue
            piece, place = (h, high, words), (key, pos)
            if h == hot:
                yield from ranges(_windows(piece, place))
                continue
            if h != last:
                if size >= step:
                    yield from ranges(_later(held))
                    held, size = {}, 0
                last, own, hot = h, 0, None
            was = held.get(piece)
            held[piece] = place if was is None else min(was, place)
            if was is None:
                own, size = own + len(words), size + len(words)
            elif was != place:  # a copy costs a row, not a place in the index
                key, pos = max(was, place)
                yield from ranges([(key, pos - high, pos - low + SPAN)])
            if own >= most:
                mine = {p: x for p, x in held.items() if p[0] == h}
                yield from ranges(_later({p: x for p, x in held.items() if p[0] != h}))
                for p, x in mine.items():
                    yield from ranges(_windows(p, x))
                hot, held, size = h, {}, 0
    yield from ranges(_later(held))
    yield from sink.flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, copy, a, z): word ranges cut out of each text."""
    sink = Sink(arrow_schema(OUT))
    for b in batches:
        for doc, text, copy, a, z in zip(*[c.to_pylist() for c in b.columns], strict=True):
            words = text.split()
            spans = _union(list(zip(a or [], z or [], strict=True))) if not copy else [(0, len(words))] if len(words) >= SPAN else []
            stays = bytearray(b"\1") * len(words)
            for x, y in spans:
                stays[x:y] = bytes(y - x)
            kept = b" ".join(compress(words, stays)).decode()
            if sink.add((doc, len(words), sum(y - x for x, y in spans), kept), len(kept)):
                yield from sink.flush()
    yield from sink.flush()


def marks(texts: DataFrame, copies: DataFrame, most: int = HOT, step: int = SORTED) -> DataFrame:
    """(key, a, z): word ranges to remove from (key, text), but for whole copies (column key)."""
    n = partitions(texts)
    found = texts.select("key", "text").mapInArrow(_find, _ANCHOR).repartition(n, "h").sortWithinPartitions("h")
    matched = found.mapInArrow(_match, "key long, pos long").groupBy("key").agg(F.collect_list("pos").alias("places"))
    places = materialize(matched.join(copies, "key", "left_anti"), "places")
    met = texts.select("key", "text").join(places, "key").select("key", "text", "places")
    dealt = met.mapInArrow(_pieces, _PIECE).repartition(n, F.coalesce("h", F.xxhash64("key", "pos"))).sortWithinPartitions(F.asc_nulls_first("h"))
    raw = materialize(dealt.mapInArrow(partial(_search, most=most, step=step), _RAW), "raw_marks")
    sure, undecided = raw.filter("digest IS NULL").select("key", "a", "z"), raw.filter("digest IS NOT NULL")
    if undecided.isEmpty():
        return sure
    at = F.struct("key", "a")
    firsts = materialize(undecided.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "firsts_of_windows")
    return sure.unionByName(undecided.join(firsts, "digest").filter(at > F.col("first")).select("key", "a", "z"))


def without_repeats(docs: DataFrame, most: int = HOT, step: int = SORTED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): a row per document; ``kept`` are its other words, joined by one space."""
    texts = _keyed(docs)
    sums = materialize(texts.select("key", "sha"), "sums")
    firsts = sums.groupBy("sha").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("sha", "least")
    least = materialize(firsts, "firsts")  # a table of its own, so that the join may split a hot text's rows
    copies = materialize(sums.join(least, "sha").filter("key > least").select("key").distinct(), "copies")
    found = materialize(marks(texts, copies, most, step).groupBy("key").agg(F.collect_list("a").alias("a"), F.collect_list("z").alias("z")), "marks")
    cut = found.unionByName(copies.select("key", F.lit(None).cast("array<bigint>").alias("a"), F.lit(None).cast("array<bigint>").alias("z")))
    joined = texts.join(cut.withColumn("copy", F.col("a").isNull()), "key", "left")
    return joined.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "a", "z").mapInArrow(_cut, OUT)


def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` without the words of earlier windows, as a digest."""
    out = without_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The query in DuckDB's SQL: every window's words, numbered among its equals.
OP12_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 20], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r),
x AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
