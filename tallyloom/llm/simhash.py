"""SimHash near-duplicates by anchor-point covering (operator 6).

Fingerprint: bit b is 1 when over half of the text's shingle hashes have it. Two fingerprints link
when they differ in at most 3 of 64 bits. Then they differ in at most one bit of one half.

Anchors: the code words of the perfect Hamming code on 31 bits (covering radius 1), for each half
(its last bit left out). A fingerprint goes to every code word within radius + threshold = 2 of
its half: one if the half is a code word, else 16, so 32 rows at most a fingerprint. If two halves
differ in at most one bit, the code word nearest to the first is within 2 of the second: they
meet. Fingerprints are compared only with those at the same anchor, with all 64 bits.

Equal fingerprints are one row before any of this, so exact copies, however many, cost nothing.
At an anchor only links that join two so far unjoined groups are given out: fewer than its rows,
however many pairs link; pairs inside a tree that is already joined are not compared (past ``LAGS``
neighbours), so a family of near copies takes no square of its size. Anchors with over ``DENSE`` fingerprints are compared in passes over runs
that agree in pieces of the half that is not anchored, where an anchor's rows are no more alike
than any others: of equal anchored halves the other ones leave one of four 8-bit pieces equal, or three of six with 16 bits or so
together; halves that differ in one bit leave one of three 11-bit pieces equal, or three of five with 18 bits or more. The finer pieces, in 20 and
10 passes, are for anchors with over ``FINE`` fingerprints. Links become classes by star rounds (graphs).

``one_of_each`` removes near-duplicates of five-word similarity. Its fingerprints are of two-word shingles
and have 128 bits, so that the code covers four blocks: texts of similarity 0.8 to 0.85 agree but for 5 bits of
64 and meet at an anchor of one block with probability 0.97 (0.99 and more above). With a row goes a sketch of four 16-bit least hashes of its shingles.
Rows that meet are candidates when the word without the block differs in at most ``FAR`` bits and one of the least hashes is equal (near texts
have none with probability 0.0016 at most, strangers have one with 0.00006), so strangers do not chain classes together. At an anchor with over ``DENSE`` rows only rows with
an equal least hash are compared, by passes over the four.

A class of candidates is compared exactly: a link is a Jaccard similarity of the sets of five-word shingles (64-bit hashes) of
at least 0.8. Texts of equal words are one row. A class is compared in one task, of over ``BLOCK``
texts or ``BYTES`` in one task for each pair of its blocks, each text at most ``BLOCKS`` times. A larger class is dealt by ``PASSES`` further least hashes of the
five-word shingles. Texts that share one are compared in one task, or in
blocks of BLOCK dealt at random in each pass, with some ``REFS`` of them in every block, which hold a dense family together. That is no cut, only
what makes the rest small: the links so far make trees, and every text outside of the class's largest tree is then compared with every
text of the class, by blocks of the ones and of the others (``outside``). Two texts of the largest tree are of one class already, so no link is lost
whatever the size of a class. A text of the largest tree is written PASSES times, plus REFS / BLOCK, and once for each block of
texts outside; where most texts of a class link to nothing the pairs are quadratic, in tasks of two blocks each.

Results: a null or empty text has fingerprint 0 and links like any other. Repeated rows are of
one class. A null doc_id counts for a class only where it has no other (component_id null). An
empty table gives no rows. Extra columns are ignored, and kept by ``one_of_each``.
"""

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, groupby, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Sink, arrow_schema, materialize, partitions, read, rows, text_of
from tallyloom.llm.graphs import components

SHINGLE = 3
SEED = 42
MOST = 3
DENSE = 48
FINE = 4096
LAGS = 64
#: Near-duplicates that are removed: words in a shingle, least similarity.
WORDS = 5
LEAST = 0.8
#: Their candidates: words in a fingerprint's shingle, most differing bits of the other 64.
CLOSE_SHINGLE = 2
FAR = 14
#: Texts and bytes that are compared in one task; blocks of a class that is compared in pairs of them.
BLOCK = 1024
BYTES = 32 << 20
BLOCKS = 8
#: Of larger classes: least hashes by which they are dealt, texts that are in every block.
PASSES = 12
REFS = 8


def shingles(text: str, width: int = SHINGLE) -> list[bytes]:
    """Lower-cased (A to Z) word shingles, repeats included; fewer words: the whole sequence."""
    w = text.encode().lower().split()
    if len(w) <= width:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)))


#: Eight bits of a hash, one a byte, so that one addition counts eight of them.
_LANES = np.uint64(0x0101010101010101)
#: Hashes added up in bytes: the most that fit.
_RUN = 255


def bit_counts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each of 64 bits; text i has the next n[i] > 0 hashes."""
    ends = np.cumsum(n)
    runs = -(-n // _RUN)
    of = np.repeat(np.arange(len(n)), runs)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = (ends - n)[of] + _RUN * inside
    firsts = np.cumsum(runs) - runs
    out = np.empty((len(n), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        out[:, k::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), firsts, axis=0, dtype=np.int64)
    return out


def _more(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash."""
    if not k:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * k & 2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Least hashes in a sketch, of 16 bits each.
LEASTS = 4


def least_hashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sketch of each text: the low 16 bits of the least of its hashes in four orders, in one word."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(LEASTS):
        low = np.minimum.reduceat(_more(h, 16 + k), starts) & np.uint64(0xFFFF)
        out |= low << np.uint64(16 * k)
    return out


def fingerprints(texts: Iterable[str], width: int = SHINGLE, words: int = 1, sketch: bool = False) -> np.ndarray:
    """Unsigned fingerprint of each text: (texts, words) of 64 bits; with ``sketch`` a last word of least hashes."""
    out, held, sizes = [], [], []

    def close() -> None:
        n = np.array(sizes, np.int64)
        fp = np.zeros((len(n), words + sketch), np.uint64)
        full = np.flatnonzero(n)
        if len(full):
            h = np.concatenate(held)
            for k in range(words):
                on = (2 * bit_counts(_more(h, k), n[full]) > n[full, None]).astype(np.uint8)
                fp[full, k] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
            if sketch:
                fp[full, words] = least_hashes(h, np.cumsum(n[full]) - n[full])
        out.append(fp)
        held.clear()
        sizes.clear()

    size = 0
    for t in texts:
        s = shingles(t, width)
        if s:
            held.append(np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64, len(s)))
        sizes.append(len(s))
        size += len(s)
        if size > 1 << 15 or len(sizes) >= 256:
            close()
            size = 0
    close()
    return np.concatenate(out)


def fingerprint_column(width: int = SHINGLE):
    """A column function from texts to fingerprints as signed 64-bit integers."""
    import pandas as pd

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        """SimHash of each text; null as the empty text."""
        return pd.Series(fingerprints((t or "" for t in texts.tolist()), width)[:, 0].view(np.int64))

    return fingerprint


class Code:
    """The perfect Hamming code of length 2**r - 1: which code words are within 2 of a word."""

    def __init__(self, r: int):
        self.n = (1 << r) - 1
        # row s: what to flip in a word of syndrome s to get each such code word (-1: none)
        self.flips = np.full((1 << r, 1 << r - 1), -1, np.int64)
        self.flips[0, 0] = 0
        for s in range(1, 1 << r):
            self.flips[s] = [1 << s - 1] + [1 << i - 1 | 1 << (i ^ s) - 1 for i in range(1, 1 << r) if i < i ^ s]
        # the XOR of the numbers of the set bits, by byte
        self.parts = [np.array([self._syndrome(v << 8 * byte) for v in range(256)]) for byte in range(self.n // 8 + 1)]

    def _syndrome(self, word: int) -> int:
        out = 0
        for b in range(self.n):
            if word >> b & 1:
                out ^= b + 1
        return out

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, code word) for all code words within 2."""
        s = np.zeros(len(x), np.int64)
        for byte, t in enumerate(self.parts):
            s ^= t[x >> 8 * byte & 255]
        flips = self.flips[s]
        i, j = np.nonzero(flips >= 0)
        return i, x[i] ^ flips[i, j]


CODE = Code(5)
HALF = np.uint64(0xFFFFFFFF)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint): all anchors of each fingerprint, of both halves. Bits 40 on of an
    anchor number the half."""
    keys, at = [], []
    for k in range(2):
        i, word = CODE.near(((fps >> np.uint64(32 * k)) & np.uint64((1 << CODE.n) - 1)).astype(np.int64))
        keys.append(word | k << 40)
        at.append(i)
    return np.concatenate(keys), np.concatenate(at)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("anchor long, fp long")
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        keys, at = anchors(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at])], schema=schema)


class Forest:
    """Union-find over positions of an array; gives out the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            n = self.up[r]
            if (n == r).all():
                self.up[x] = r
                return r
            r = n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        apart = self.roots(i) != self.roots(j)
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((a, b))


def _compare(forest: Forest, order: np.ndarray, group: np.ndarray, near: Callable) -> int:
    """Join all pairs of equal ``group`` (sorted along ``order``) that ``near`` says are links; how many pairs
    were compared. Pairs at distances up to LAGS come first. By then a close family is one tree; in groups that go
    on, the rows outside of the largest tree are compared with all others, the tree's own pairs are not."""
    i, pairs = np.arange(len(order)), 0
    for lag in range(1, LAGS + 1):
        i = i[i + lag < len(order)]
        i = i[group[i] == group[i + lag]]
        if not len(i):
            return pairs
        pairs += len(i)
        a, b = order[i], order[i + lag]
        hit = near(a, b)
        forest.join(a[hit], b[hit])
    for g in np.unique(group[i]).tolist():
        rows = order[np.searchsorted(group, g, "left") : np.searchsorted(group, g, "right")]
        roots = forest.roots(rows)
        trees, size = np.unique(roots, return_counts=True)
        inner = roots == trees[np.argmax(size)]
        rows = np.concatenate((rows[~inner], rows[inner]))
        out = int((~inner).sum())
        for k in range(out):
            hit = rows[k + 1 :][near(rows[k + 1 :], rows[k])]
            forest.join(np.full(len(hit), rows[k]), hit)
        pairs += out * len(rows) - out * (out + 1) // 2
    return pairs


def _within(fps: np.ndarray, most: int) -> Callable:
    return lambda a, b: np.bitwise_count(fps[a] ^ fps[b]) <= most


def _masks(pieces: int, equal: int) -> list[int]:
    """Masks of 32 bits for all choices of ``equal`` of so many pieces."""
    bounds = [32 * k // pieces for k in range(pieces + 1)]
    piece = [(1 << b) - (1 << a) for a, b in pairwise(bounds)]
    return [sum(c) for c in combinations(piece, equal)]


#: Masks for equal anchored halves, and for halves that differ in a bit: for crowded anchors, for very crowded ones.
_COARSE = _masks(4, 1), _masks(3, 1)
_FINER = _masks(6, 3), _masks(5, 3)


def links(keys: np.ndarray, fps: np.ndarray, most: int = MOST) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the links among fingerprints that meet at anchors ``keys`` (sorted), and how many pairs
    were compared. Every link is found at an anchor of a half in which it differs in at most one bit."""
    forest, near = Forest(len(keys)), _within(fps, most)
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= DENSE), sizes))
    pairs = _compare(forest, at, keys[at], near)
    for least, top, (alike, apart) in ((DENSE, FINE, _COARSE), (FINE, 2**62, _FINER)):
        part = np.flatnonzero(np.repeat((sizes > least) & (sizes <= top), sizes))
        if not len(part):
            continue
        group = np.repeat(np.arange(len(sizes)), sizes)[part]
        upper = (keys[part] >> 40).astype(np.uint64)  # 1: the upper half is anchored
        own, rest = (fps[part] >> (np.uint64(32) * upper)) & HALF, (fps[part] >> (np.uint64(32) * (np.uint64(1) - upper))) & HALF
        for same, mask in [(own, m) for m in alike] + [(np.zeros_like(own), m) for m in apart]:
            piece = rest & np.uint64(mask)
            o = np.lexsort((piece, same, group))
            new = (group[o][1:] != group[o][:-1]) | (same[o][1:] != same[o][:-1]) | (piece[o][1:] != piece[o][:-1])
            pairs += _compare(forest, part[o], np.cumsum(np.concatenate(([False], new))), near)
    return forest.links, pairs


def _runs(batches: Iterator[pa.RecordBatch], size: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, in runs of about ``size`` rows that keep its values together."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n >= size:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield [c[:cut] for c in cols]
            held = [[c[cut:] for c in cols]]
            n = 0 if cut else n // 2
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _link(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (anchor, fp) sorted by anchor."""
        schema = arrow_schema("a long, b long")
        for keys, fps in _runs(batches):
            got, _ = links(keys, fps.view(np.uint64), most)
            if got:
                i, j = np.array(got).T
                yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], schema=schema)

    return run


def class_roots(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, root) of every distinct fingerprint (column fp) that links to another; root is the smallest of its class."""
    if not 0 <= most <= 3:
        raise ValueError("thresholds of 0 to 3 bits")
    rows = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    dealt = rows.repartition(partitions(distinct), "anchor").sortWithinPartitions("anchor", "fp")
    found = components(dealt.mapInArrow(_link(most), "a long, b long"))
    return found.select(F.col("node").alias("fp"), "root")


def classes(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, component_id): smallest doc_id that is reachable, of the table (doc_id, fp)."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    rooted = distinct.join(class_roots(distinct, most), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lows, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(width)(text_of()).alias("fp"))
    fps = materialize(slim, "fingerprints")
    named = fps.join(classes(fps, most), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _word_key(text: str) -> bytes:
    """128 bits that tell texts of different words apart."""
    return xxhash.xxh128_digest(b" ".join(text.encode().lower().split()))


def _marks(width: int):
    """A column function from texts to (w0, w1, sketch, key)."""
    import pandas as pd

    @F.pandas_udf("w0 long, w1 long, sketch long, key binary")
    def marks(texts: pd.Series) -> pd.DataFrame:
        """SimHash of 128 bits, sketch and word key of each text."""
        given = texts.tolist()
        fp = fingerprints(given, width, 2, True).view(np.int64)
        return pd.DataFrame({"w0": fp[:, 0], "w1": fp[:, 1], "sketch": fp[:, 2], "key": [_word_key(t) for t in given]})

    return marks


CLOSE = "anchor long, other long, sketch long, row long"


def _close_replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w0, w1, sketch, row) to the anchors of the blocks of both words, each with the word that is not anchored."""
    schema = arrow_schema(CLOSE)
    for b in batches:
        w0, w1, sketch, row = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        for k, (word, other) in enumerate(((w0, w1), (w1, w0))):
            keys, at = anchors(word.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys | k << 48), pa.array(other[at]), pa.array(sketch[at]), pa.array(row[at])], schema=schema)


def close_links(keys: np.ndarray, other: np.ndarray, sketch: np.ndarray, far: int = FAR) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the candidates among rows that meet at anchors ``keys`` (sorted), and how many pairs were compared."""
    forest = Forest(len(keys))

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = sketch[a] ^ sketch[b]
        one = np.zeros(np.shape(apart), bool)
        for k in range(LEASTS):
            one |= (apart >> np.uint64(16 * k)) & np.uint64(0xFFFF) == 0
        return one & (np.bitwise_count(other[a] ^ other[b]) <= far)

    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= DENSE), sizes))
    pairs = _compare(forest, at, keys[at], near)
    part = np.flatnonzero(np.repeat(sizes > DENSE, sizes))
    group = np.repeat(np.arange(len(sizes)), sizes)[part]
    for k in range(LEASTS if len(part) else 0):
        low = (sketch[part] >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        o = np.lexsort((low, group))
        new = (group[o][1:] != group[o][:-1]) | (low[o][1:] != low[o][:-1])
        pairs += _compare(forest, part[o], np.cumsum(np.concatenate(([False], new))), near)
    return forest.links, pairs


def _close_link(far: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of CLOSE sorted by anchor; gives a spanning forest of the candidates."""
        schema = arrow_schema("a long, b long")
        for keys, other, sketch, row in _runs(batches):
            found, _ = close_links(keys, other.view(np.uint64), sketch.view(np.uint64), far)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(row[j])], schema=schema)

    return run


def candidate_roots(best: DataFrame, far: int = FAR) -> DataFrame:
    """(row, root): classes of candidates of the distinct texts (w0, w1, sketch, row), lone ones left out."""
    rows = best.select("w0", "w1", "sketch", "row").mapInArrow(_close_replicate, CLOSE)
    dealt = rows.repartition(partitions(best), "anchor").sortWithinPartitions("anchor", "row")
    return components(dealt.mapInArrow(_close_link(far), "a long, b long")).select(F.col("node").alias("row"), "root")


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    s = shingles(text, words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64, len(s)))


def similar_links(texts: list[str], words: int = WORDS, least: float = LEAST, first: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of all pairs of texts whose shingle sets have at least this Jaccard
    similarity; two empty ones do. A text's shared shingles are counted for all others at once, by postings;
    texts of which too few shingles are in any other are passed over. With ``first``, of the pairs that have one of so many first texts."""
    sets = [shingle_set(t, words) for t in texts]
    n, sizes = len(sets), np.array([len(x) for x in sets])
    forest = Forest(n)
    blank = np.flatnonzero(sizes == 0)
    forest.join(np.full(len(blank), blank[0] if len(blank) else 0), blank)
    if not sizes.any():
        return forest.links
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    many = np.bincount(ids)
    begin = np.cumsum(many) - many
    ends = np.cumsum(sizes)
    left = n - len(forest.links)
    for i in range(n if first is None else first):
        own = ids[ends[i] - sizes[i] : ends[i]]
        own = own[many[own] > 1]
        if left == 1 or not len(own) or len(own) < least * sizes[i]:
            continue
        c = many[own]
        at = np.repeat(begin[own] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both = np.bincount(owner[at], minlength=n)[i + 1 :]
        near = np.flatnonzero(both >= least * (sizes[i] + sizes[i + 1 :] - both)) + i + 1
        near = near[sizes[near] > 0]
        before = len(forest.links)
        forest.join(np.full(len(near), i), near)
        left -= len(forest.links) - before
    return forest.links


def _confirm(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (root, i, j, row, text) sorted by (root, i, j), the texts of one comparison. With a further column ``rest``, sorted by it too,
        no two texts that have it are compared."""
        sink = Sink(arrow_schema("a long, b long"))
        for _, group in groupby(rows(batches), key=lambda r: r[:3]):
            at, texts, *rest = zip(*[r[3:] for r in group], strict=True)
            for i, j in similar_links(list(texts), words, least, rest[0].count(False) if rest else None):
                if sink.add((at[i], at[j])):
                    yield from sink.flush()
        yield from sink.flush()

    return run


def _deal(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(root, pass, least, row, size) of rows (root, row, text): the least hash of each pass."""
        sink = Sink(arrow_schema("root long, pass int, least long, row long, size long"))
        for root, row, text in rows(batches):
            h = np.fromiter(map(xxhash.xxh64_intdigest, s := shingles(text, words), repeat(SEED)), np.uint64, len(s))
            for k in range(PASSES):
                low = int(_more(h, 32 + k).min().view(np.int64)) if len(h) else 0
                if sink.add((root, k, low, row, len(text))):
                    yield from sink.flush()
        yield from sink.flush()

    return run


def _blocks(n: str, size: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BYTES)).cast("int")


def comparisons(base: DataFrame, rooted: DataFrame, words: int) -> DataFrame:
    """(root, i, j, row): which texts are compared with each other, those of equal (root, i, j). ``rooted``: (row, size, root)."""
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1").select("root", _blocks("n", "bytes").alias("n"))
    own = materialize(rooted.join(sizes, "root"), "classes")
    # with several blocks, each pair of different ones: that compares the texts of a block too
    small = own.filter(F.col("n") <= BLOCKS).withColumn("own", F.pmod(F.xxhash64("row"), "n").cast("int"))
    pair = F.explode(F.expr("filter(sequence(0, n - 1), x -> n = 1 or x <> own)")).alias("x")
    out = small.select("root", "row", "own", pair).select("root", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "row")
    large = own.filter(F.col("n") > BLOCKS).select("root", "row")
    if large.isEmpty():
        return out
    texts = large.join(base.select(F.col("__row").alias("row"), "__text"), "row").select("root", "row", "__text")
    keys = materialize(texts.mapInArrow(_deal(words), "root long, pass int, least long, row long, size long").withColumn("g", F.xxhash64("root", "pass", "least")), "least_hashes")
    groups = keys.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1").withColumn("blocks", _blocks("n", "bytes"))
    hashed = keys.join(groups, "g").withColumn("hash", F.xxhash64("row", "g"))
    every = F.shiftrightunsigned("hash", 1) / F.lit(2.0**63) < F.lit(REFS) / F.col("n")
    block = F.when((F.col("blocks") > 1) & every, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod("hash", "blocks").cast("int")))
    return out.unionByName(hashed.select(F.col("g").alias("root"), F.explode(block).alias("i"), F.lit(-1).alias("j"), "row"))


def outside(rooted: DataFrame, found: DataFrame) -> DataFrame | None:
    """(root, i, j, row, rest): the comparisons that are left in classes of over BLOCKS blocks when ``found`` (row, root) is linked; None if there are none.
    Texts outside of a class's largest tree meet each other and, as ``rest``, all texts of that tree."""
    large = rooted.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter(_blocks("n", "bytes") > BLOCKS).select("root")
    large = materialize(rooted.join(large, "root"), "large_classes")
    if large.isEmpty():
        return None
    trees = large.join(found.select("row", F.col("root").alias("tree")), "row", "left").withColumn("tree", F.coalesce("tree", "row"))
    totals = trees.groupBy("root", "tree").agg(F.count("*").alias("n"))
    top = totals.groupBy("root").agg(F.max_by("tree", F.struct("n", "tree")).alias("top"), F.count("*").alias("trees")).filter("trees > 1").select("root", "top")
    whole = trees.join(top, "root").select("root", "row", "size", (F.col("tree") == F.col("top")).alias("rest"))
    part = whole.groupBy("root", "rest").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("root", "rest", _blocks("n", "bytes").alias("n"))
    both = part.groupBy("root").agg(F.sum(F.when(~F.col("rest"), F.col("n"))).alias("outer"), F.sum(F.when(F.col("rest"), F.col("n"))).alias("inner"))
    dealt = whole.join(both, "root").withColumn("own", F.pmod(F.xxhash64("row"), F.when(F.col("rest"), F.col("inner")).otherwise(F.col("outer"))) + F.when(F.col("rest"), F.col("outer")).otherwise(0))
    # an outer block meets all other blocks, an inner one the outer ones
    met = F.explode(F.expr("filter(sequence(CAST(0 AS BIGINT), IF(rest, outer, outer + inner) - 1), x -> x <> own)")).alias("x")
    pairs = dealt.select("root", "row", "rest", "own", met)
    return pairs.select("root", F.least("own", "x").cast("int").alias("i"), F.greatest("own", "x").cast("int").alias("j"), "row", "rest")


def _links(base: DataFrame, met: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b): the links among the texts that ``met`` brings together."""
    met = met.join(base.select(F.col("__row").alias("row"), "__text"), "row").select("root", "i", "j", "row", "__text", *[c for c in met.columns if c == "rest"])
    met = met.repartition(partitions(base), "root", "i", "j").sortWithinPartitions("root", "i", "j", *met.columns[5:])
    return met.mapInArrow(_confirm(words, least), "a long, b long")


def _confirmed_roots(base: DataFrame, best: DataFrame, far: int, words: int, least: float) -> DataFrame:
    """(row, root) of the distinct texts ``best`` (w0, w1, sketch, row, size) that are confirmed to be near others."""
    rooted = best.join(candidate_roots(best, far), "row", "left").select("row", "size", F.coalesce("root", "row").alias("root"))
    found = components(_links(base, comparisons(base, rooted, words), words, least)).select(F.col("node").alias("row"), "root")
    left = outside(rooted, found)
    if left is None:
        return found
    linked = _links(base, left, words, least).unionByName(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    return components(linked).select(F.col("node").alias("row"), "root")


def one_of_each(docs: DataFrame, width: int = CLOSE_SHINGLE, far: int = FAR, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class of confirmed links, the row of the
    smallest doc_id (of repeated rows one; null ids last)."""
    names = docs.columns
    taken = docs.select(*[F.col(c).alias(f"__in_{k}") for k, c in enumerate(names)], F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__id"), F.monotonically_increasing_id().alias("__row"), _marks(width)(text_of()).alias("__marks"))
    base = materialize(taken.select("*", "__marks.w0", "__marks.w1", "__marks.sketch", "__marks.key").drop("__marks"), "with_fingerprints")
    text = base.withColumn("__text", text_of(f"__in_{[c.lower() for c in names].index('text')}"))
    firsts = text.groupBy("w0", "w1", "sketch", "key").agg(F.min(F.struct("__id", "__row")).alias("best"), F.max(F.octet_length("__text")).alias("size"))
    best = materialize(firsts.select("w0", "w1", "sketch", "best", "size", F.col("best.__row").alias("row")), "distinct")
    rooted = best.join(_confirmed_roots(text, best, far, words, least), "row", "left").select("best", F.coalesce("root", "row").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.__row").alias("__row"))
    return base.join(stay, "__row", "left_semi").select(*[F.col(f"__in_{k}").alias(c) for k, c in enumerate(names)])


def op6_anchor_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
