"""A compressed full-text index over sequences of words, and matching statistics by backward search (operator 12).

The index of a shard's pieces is the Burrows-Wheeler transform of the pieces laid end to end, each closed by an end mark of its own, in a
wavelet tree: words are coded by their frequency (Shannon's code, at most one bit above the entropy), and a level of
the tree holds one bit for each word whose code is longer than the level. Occurrences of a word before a place are counted down the
tree with one look at packed bits a level. Beside it stands a byte a place: how many words the suffix there
shares with the one before it (up to ``cap``), from which shorter matches' intervals follow.

Matching statistics: a query is read from its last word to its first. The interval of suffixes that begin with the current match
is narrowed by the word before it; where that leaves none, the match is cut from the right to the next length that
occurs more widely (the parent interval) and tried again. Matches are also cut at ``cap`` words, so that the interval is that of the
first ``cap`` words. All queries of a batch go one word a round, in numpy.
"""

import numpy as np

from tallyloom.llm.runs import common_prefixes, suffix_names


class Bits:
    """Packed bits with counts of ones."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(64 * n, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1])).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part)


class WaveletTree:
    """A sequence of symbols 0, 1, ... in Shannon's code, a level of bits at a time."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        n = len(seq)
        counts = np.bincount(seq, minlength=n_symbols)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        f = counts[order].astype(np.int64)
        size = np.maximum(np.ceil(np.log2(n / f)).astype(np.int64), 1)
        size += (f << size) < n
        codes = ((np.cumsum(f) - f) << size) // n
        self.size, self.code = np.zeros(n_symbols, np.int64), np.zeros(n_symbols, np.int64)
        self.size[order], self.code[order] = size, codes
        self.levels: list[Bits] = []
        self.start: list[np.ndarray] = []  # by symbol: where its node begins on a level
        self.ones: list[np.ndarray] = []  # and the ones before that
        place = np.zeros(n_symbols, np.int64)
        for level in range(int(size.max())):
            bits = (self.code[seq] >> (self.size[seq] - 1 - level)) & 1
            packed = Bits(bits)
            ones = packed.ones(place)
            self.levels.append(packed)
            self.start.append(place.astype(np.int32))
            self.ones.append(ones.astype(np.int32))
            # on the next level a node's zeros come first, then its ones; symbols whose code has ended are left out
            live = size > level + 1
            prefix = codes[live] >> (size[live] - level - 1)
            before = np.cumsum(f[live]) - f[live]
            head = np.concatenate(([True], prefix[1:] != prefix[:-1])) if live.any() else np.zeros(0, bool)
            after = np.zeros(n_symbols, np.int64)
            after[order[live]] = np.maximum.accumulate(np.where(head, before, 0))
            seen = np.cumsum(bits) - bits - ones[seq]
            rank = np.where(bits == 1, seen, np.arange(len(seq)) - place[seq] - seen)
            goes = self.size[seq] > level + 1
            to = after[seq[goes]] + rank[goes]
            moved = np.empty(len(to), seq.dtype)
            moved[to] = seq[goes]
            seq, place = moved, after

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        i = i.copy()
        live = np.arange(len(i))
        for level, bits in enumerate(self.levels):
            s = symbol[live]
            ones = bits.ones(self.start[level][s] + i[live]) - self.ones[level][s]
            one = (self.code[s] >> (self.size[s] - 1 - level)) & 1
            i[live] = np.where(one == 1, ones, i[live] - ones)
            live = live[self.size[s] > level + 1]
            if not len(live):
                break
        return i


class FmIndex:
    """Of pieces of ``sizes`` words (0, 1, ...) laid end to end. ``place``: a number for each word, of which ``first`` keeps the least for each
    interval of suffixes that share ``cap`` words."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, place: np.ndarray, cap: int):
        pieces, n_words = len(sizes), int(ids.max(initial=-1)) + 1
        n = len(ids) + pieces
        ends = np.cumsum(sizes + 1) - 1
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = ids + pieces  # end marks are the least symbols, each its own
        text[ends] = np.arange(pieces)
        left = n - np.arange(n)
        names, order, level = suffix_names(text, np.zeros(n, np.int64), left)
        self.cap, self.n, self.n_words = cap, n, n_words
        self.shared = np.append(np.minimum(common_prefixes(names, order, level, left), cap), 0).astype(np.uint8)
        before = text[order - 1] - pieces + 1
        self.tree = WaveletTree(np.maximum(before, 0), n_words + 1)
        counts = np.bincount(ids, minlength=n_words)
        self.smaller = pieces + np.cumsum(counts) - counts  # symbols less than each word
        self.starts: dict[int, np.ndarray] = {}
        every = np.full(n, np.iinfo(np.int64).max)
        every[inside] = place
        self.first = np.minimum.reduceat(every[order], self._starts(cap))

    def _starts(self, depth: int) -> np.ndarray:
        """Where the intervals of suffixes that share ``depth`` words begin."""
        if depth not in self.starts:
            new = self.shared[: self.n] < depth
            new[0] = True
            self.starts[depth] = np.flatnonzero(new)
        return self.starts[depth]

    def widen(self, low: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, low, high) of the interval of suffixes that share ``depth`` words and hold ``low``."""
        starts = self._starts(depth)
        k = np.searchsorted(starts, low, "right") - 1
        return k, starts[k], np.append(starts, self.n)[k + 1]

    def narrow(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``word`` followed by what the given ones stand for; low = high for none. Word -1 is in no piece."""
        out = np.zeros((2, len(word)), np.int64)
        known = (word >= 0) & (word < self.n_words)
        k = np.flatnonzero(known)[self.tree.size[word[known] + 1] > 0]
        w = np.concatenate((word[k], word[k]))
        to = self.smaller[w] + self.tree.rank(w + 1, np.concatenate((low[k], high[k])))
        out[0, k], out[1, k] = to[: len(k)], to[len(k) :]
        return out[0], out[1]

    def matching_statistics(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, number): for each word of the queries how many words from there on stand in the index, at most ``cap``, and where that
        is ``cap``, the interval's number, by which ``first`` is asked; else -1."""
        length, number = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        by_size = np.argsort(-sizes, kind="stable")
        last = (np.cumsum(sizes) - 1)[by_size]
        low, high, now = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        for step in range(int(sizes.max(initial=0))):
            live = np.arange(int((sizes[by_size] > step).sum()))
            at = last[live] - step
            todo = live
            while len(todo):
                a, z = self.narrow(ids[last[todo] - step], low[todo], high[todo])
                hit = a < z
                low[todo[hit]], high[todo[hit]] = a[hit], z[hit]
                now[todo[hit]] += 1
                todo = todo[~hit & (now[todo] > 0)]
                depth = np.maximum(self.shared[low[todo]], self.shared[high[todo]]).astype(np.int64)
                depth = np.minimum(depth, now[todo] - 1)
                for d in np.unique(depth).tolist():
                    k = todo[depth == d]
                    now[k] = d
                    low[k], high[k] = self.widen(low[k], d)[1:] if d else (0, self.n)
            full = live[now[live] >= self.cap]
            if len(full):
                number[last[full] - step], low[full], high[full] = self.widen(low[full], self.cap)
                now[full] = self.cap
            length[at] = now[live]
        return length, number
