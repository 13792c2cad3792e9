"""Removal of long repeats across and within documents (operator 1), by sorting suffixes.

Every byte is removed that a 100-byte string covers which also starts earlier. Plan:

1. Whole copies of an earlier text (equal SHA-256) go by aggregation; no group meets in a task.
2. ``anchors`` of all texts, one in about 33 bytes. Each task keeps one row per anchor hash: hashes
   that repeat within the task are decided there. One shuffle by hash decides the others. So a
   passage that a third of the texts share costs one row a task.
3. Anchors whose hash repeats meet their text (one shuffle by document) and become contexts: the
   100 to 168 bytes around an anchor that its windows span. Of equal contexts a task ships the first;
   the others' windows are known to start earlier. One shuffle by hash.
4. Each hash's contexts are sorted by deep-shallow suffix sorting, forward and backward, and every
   window but the first of its kind is marked. A task holds the distinct contexts of one hash
   at a time, up to ``HOT`` bytes. An anchor with more of them (a short passage before very many different
   texts) gives out its windows one by one instead, by a 128-bit digest; their firsts are
   minima, added up before the shuffle, so that such windows meet in no task.
5. Marked intervals meet their text (one shuffle by document) and are cut out.

Bytes are compared exactly, but for the windows of hot anchors; a hash only decides what is compared.
A task holds some 40 bytes of arrays for a byte of the block at hand: BLOCK, or the longest text.

Results: a null text is empty. Documents are ordered by doc_id, nulls first. Repeated rows (equal
doc_id and text) are one document: all get its result. Rows that share a doc_id, or have none, but
not the text are ordered by the text's SHA-256. An empty table gives no rows. Extra columns are ignored.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Sink, arrow_schema, materialize, partitions, read, text_of
from tallyloom.llm.suffixes import SPAN, anchors, later_windows, take

#: Bytes of text worked on at once; of contexts sorted at once; contexts remembered by a task.
BLOCK = 1 << 20
SORTED = 4 << 20
REMEMBERED = 200_000
HOT = 64 << 20
#: Anchors gathered before a task gives them out.
GATHERED = 1_000_000
_RAW = "key long, a long, z long, digest binary"
_ANCHOR = "h long, key long, pos long"
_CONTEXT = "h long, key long, pos long, low int, high int, bytes binary"


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _blocks(keys: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of texts of about BLOCK bytes; a longer text is a run of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield keys[begin:i], texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield keys[begin:], texts[begin:]


def _ends(texts: list[bytes]) -> np.ndarray:
    return np.cumsum([len(t) for t in texts])


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, key, pos): anchors to be matched; pos -1: the hash repeats in this task; -2 - pos: a
    decided anchor, dealt by place instead of by hash."""
    schema = arrow_schema(_ANCHOR)
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def give() -> Iterator[pa.RecordBatch]:
        h, key, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        o = np.argsort(h, kind="stable")
        h, key, pos = h[o], key[o], pos[o]
        first = np.concatenate(([True], h[1:] != h[:-1]))
        lone = first & np.concatenate((first[1:], [True]))
        twice = first & ~lone
        many = ~lone
        out_h = np.concatenate((h[lone], h[twice], _spread(key[many], pos[many])))
        out_k = np.concatenate((key[lone], np.zeros(int(twice.sum()), np.int64), key[many]))
        out_p = np.concatenate((pos[lone], np.full(int(twice.sum()), -1), -2 - pos[many]))
        for i in range(0, len(out_h), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield _batch(schema, out_h[s], out_k[s], out_p[s])

    for b in batches:
        for keys, texts in _blocks(b.column(0).to_numpy(), b.column(1).to_pylist()):
            ends = _ends(texts)
            h, pos, _, _ = anchors(np.frombuffer(b"".join(texts), np.uint8), ends)
            if not len(h):
                continue
            at = np.searchsorted(ends, pos, "right")
            held.append((h.view(np.int64), keys[at], pos - np.concatenate(([0], ends))[at]))
            count += len(h)
            if count >= GATHERED:
                yield from give()
                held, count = [], 0
    if held:
        yield from give()


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pos) of anchors whose hash repeats. Rows are sorted by h; a hash may span batches."""
    schema = arrow_schema("key long, pos long")
    last_h, last = None, None  # the last undecided hash, and its row while that is alone
    for b in batches:
        h, key, pos = (c.to_numpy() for c in b.columns)
        done = pos <= -2
        if done.any():
            yield _batch(schema, key[done], -2 - pos[done])
            h, key, pos = h[~done], key[~done], pos[~done]
        if not len(h):
            continue
        same = np.concatenate(([h[0] == last_h], h[1:] == h[:-1]))
        many = same.copy()
        many[:-1] |= same[1:]
        if same[0] and last is not None:
            yield _batch(schema, [last[0]], [last[1]])
        give = many & (pos >= 0)
        if give.any():
            yield _batch(schema, key[give], pos[give])
        last_h = h[-1]
        last = None if many[-1] or pos[-1] < 0 else (int(key[-1]), int(pos[-1]))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors at the given places; those equal to an earlier one of the task come
    back decided: h null, (low, high) the windows' offsets."""
    schema = arrow_schema(_CONTEXT)
    seen: dict[tuple[bytes, int], tuple[int, int]] = {}
    for b in batches:
        keys_all, places = b.column(0).to_numpy(), b.column(2)
        flat, starts = places.flatten().to_numpy(), places.offsets.to_numpy()
        done = 0
        for keys, texts in _blocks(keys_all, b.column(1).to_pylist()):
            ends = _ends(texts)
            begins = np.concatenate(([0], ends[:-1]))
            buf = np.frombuffer(b"".join(texts), np.uint8)
            h, pos, first, last = anchors(buf, ends)
            wanted = flat[starts[done] : starts[done + len(keys)]] + np.repeat(begins, np.diff(starts[done : done + len(keys) + 1]))
            done += len(keys)
            keep = np.isin(pos, wanted)
            h, pos, first, last = h[keep].view(np.int64), pos[keep], first[keep], last[keep]
            at = np.searchsorted(ends, pos, "right")
            key, place, high, low = keys[at], pos - begins[at], pos - first, pos - last
            data, offsets = take(buf, first, last - first + SPAN)
            raw, o = data.tobytes(), offsets.tolist()
            ship, known = [], []
            for i, (k, p, g) in enumerate(zip(key.tolist(), place.tolist(), high.tolist(), strict=True)):
                c, me = (raw[o[i] : o[i + 1]], g), (k, p)
                was = seen.get(c)
                if was is not None and was < me:
                    known.append(i)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[c] = me
                ship.append(i)
            if ship:
                s = np.array(ship)
                d, off = take(data, offsets[s], offsets[s + 1] - offsets[s])
                binary = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(d.tobytes())])
                yield _batch(schema, h[s], key[s], place[s], low[s].astype(np.int32), high[s].astype(np.int32), binary)
            if known:
                s = np.array(known)
                yield _batch(schema, pa.nulls(len(s), pa.int64()), key[s], place[s], low[s].astype(np.int32), high[s].astype(np.int32), pa.nulls(len(s), pa.binary()))


def _windows(batches: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts, with its digest."""
    sink = Sink(schema, 1 << 16)
    for b in batches:
        for _, key, pos, low, high, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
            for o in range(low, high + 1):
                if sink.add((key, pos - o, pos - o + SPAN, xxhash.xxh128_digest(raw[high - o : high - o + SPAN]))):
                    yield from sink.flush()
    yield from sink.flush()


def _mark(batches: Iterator[pa.RecordBatch], most: int, step: int) -> Iterator[pa.RecordBatch]:
    """(key, a, z, digest): byte ranges covered by windows that start earlier elsewhere; those with a digest are
    windows of hot anchors, to be decided. Rows come sorted by h, decided ones (h null) first."""
    schema = arrow_schema(_RAW)
    held: list[pa.RecordBatch] = []
    size = 0
    hot: int | None = None

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, key, pos, low, high = (t.column(i).to_numpy().astype(np.int64) for i in range(5))
        o = np.lexsort((pos, key, h))
        hs = h[o]
        lone = np.concatenate(([True], hs[1:] != hs[:-1])) & np.concatenate((hs[1:] != hs[:-1], [True]))
        o = o[~lone]
        if not len(o):
            return
        raw = t.column(5).combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data, offsets = take(np.frombuffer(raw.buffers()[2], np.uint8), off[:-1][o], (off[1:] - off[:-1])[o])
        least, most = later_windows(data, offsets, h[o], key[o], pos[o], low[o], high[o])
        hit = most >= 0
        yield _batch(schema, key[o][hit], (pos[o] - most)[hit], (pos[o] - least)[hit] + SPAN, pa.nulls(int(hit.sum()), pa.binary()))

    for b in batches:
        decided = b.column(0).is_null()
        if decided.true_count:
            d = b.filter(decided)
            key, pos, low, high = (d.column(i).to_numpy().astype(np.int64) for i in range(1, 5))
            yield _batch(schema, key, pos - high, pos - low + SPAN, pa.nulls(len(key), pa.binary()))
            b = b.filter(decided.to_numpy(zero_copy_only=False) == False) if decided.true_count < b.num_rows else b.slice(0, 0)  # noqa: E712
        if hot is not None and b.num_rows:
            n = int(np.searchsorted(b.column(0).to_numpy(), hot, "right"))
            yield from _windows([b.slice(0, n)], schema)
            b = b.slice(n)
        if not b.num_rows:
            continue
        hot = None
        held.append(b)
        size += b.column(5).nbytes
        if size >= step:
            t = pa.Table.from_batches(held)
            h = t.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut:
                yield from work(t.slice(0, cut))
                t = t.slice(cut)
            held = t.combine_chunks().to_batches()
            last = sum(x.column(5).nbytes for x in held)
            size = last if cut else size // 2
            if last >= most:
                yield from _windows(held, schema)
                hot, held, size = int(h[-1]), [], 0
    if held:
        yield from work(pa.Table.from_batches(held))


def _union(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges."""
    out: list[list[int]] = []
    for a, z in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, copy, a, z): spans cut out of each text."""
    sink = Sink(arrow_schema(OUT))
    for b in batches:
        for doc, text, copy, a, z in zip(*[c.to_pylist() for c in b.columns], strict=True):
            spans = _union(list(zip(a or [], z or [], strict=True))) if not copy else [(0, len(text))] if len(text) >= SPAN else []
            kept, at = [], 0
            for x, y in spans:
                kept.append(text[at:x])
                at = y
            kept.append(text[at:])
            if sink.add((doc, len(text), sum(y - x for x, y in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest())):
                yield from sink.flush()
    yield from sink.flush()


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text binary, sha): ``key`` orders documents; it is the doc_id where ids are unique."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    slim = slim.withColumn("sha", F.sha2("text", 256))
    ids = materialize(slim.select("doc_id", "sha").distinct(), "ids")
    if ids.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return slim.withColumn("key", F.col("doc_id"))
    # ids that do not name a text: number the texts in order, by ranges of ids
    n = partitions(docs)
    part = materialize(ids.repartitionByRange(n, "doc_id", "sha").withColumn("part", F.spark_partition_id()), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = part.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "sha"))
    named = part.withColumn("row", inside).join(base, "part").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), (F.col("base") + F.col("row")).alias("key"))
    return slim.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha"))).drop("__id", "__sha")


def marks(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, a, z) ranges to remove from (key, text), but for whole copies (column key)."""
    n = partitions(texts)
    found = texts.select("key", "text").mapInArrow(_find, _ANCHOR).repartition(n, "h").sortWithinPartitions("h")
    matched = found.mapInArrow(_match, "key long, pos long").groupBy("key").agg(F.collect_list("pos").alias("places"))
    places = materialize(matched.join(copies, "key", "left_anti"), "places")
    met = texts.select("key", "text").join(places, "key").select("key", "text", "places")
    contexts = met.mapInArrow(_contexts, _CONTEXT)
    deal = F.coalesce("h", F.xxhash64("key", "pos"))
    dealt = contexts.repartition(n, deal).sortWithinPartitions(F.asc_nulls_first("h"))
    raw = materialize(dealt.mapInArrow(partial(_mark, most=HOT, step=SORTED), _RAW), "raw_marks")
    sure, open_ = raw.filter("digest IS NULL").select("key", "a", "z"), raw.filter("digest IS NOT NULL")
    if open_.isEmpty():
        return sure
    at = F.struct("key", "a")
    firsts = materialize(open_.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "firsts_of_windows")
    return sure.unionByName(open_.join(firsts, "digest").filter(at > F.col("first")).select("key", "a", "z"))


def repeats(docs: DataFrame) -> DataFrame:
    """The contract's columns, a row per document."""
    texts = _keyed(docs)
    sums = materialize(texts.select("key", "sha"), "sums")
    firsts = sums.groupBy("sha").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("sha", "least")
    least = materialize(firsts, "firsts")  # a table of its own, so that the join may split a hot text's rows
    copies = materialize(sums.join(least, "sha").filter("key > least").select("key").distinct(), "copies")
    found = materialize(marks(texts, copies).groupBy("key").agg(F.collect_list("a").alias("a"), F.collect_list("z").alias("z")), "marks")
    cut = found.unionByName(copies.select("key", F.lit(None).cast("array<bigint>").alias("a"), F.lit(None).cast("array<bigint>").alias("z")))
    joined = texts.join(cut.withColumn("copy", F.col("a").isNull()), "key", "left")
    return joined.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "a", "z").mapInArrow(_digest, OUT)


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"))


#: The query in DuckDB's SQL: every 100-byte window in hexadecimal, numbered among its equals.
OP1_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
n AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, run),
e AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
