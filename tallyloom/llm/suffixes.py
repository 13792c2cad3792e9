"""Byte-level parts of the repeat search (operator 1): anchors, deep-shallow sorting, first copies.

An anchor is the minimizer of a window: of the ``GRAM``-byte strings that start in a window of
``SPAN`` bytes the one with the least hash, the leftmost on ties. It depends on the window's bytes
alone, so equal windows have their anchors at the same place, with the same bytes. Windows that
share an anchor are consecutive; on average an anchor serves SPAN - GRAM over two of them.

Equal windows at an anchor share ``o`` bytes to its left and SPAN - o to its right. So the suffixes
that begin at anchors are sorted, and so are the reversed texts before them, with the lengths
of common prefixes; runs in the two orders name a window's two parts exactly, for every ``o``.

Sorting is deep-shallow: partition steps on words of 8 bytes down to the shallow depth, for all
groups at once (multikey quicksort with as many pivots as words), then blind tries for groups with
longer common prefixes. A blind trie is built around one string: another string leaves the
pivot's path at their common length, by its next byte; strings that leave at the same place by
the same byte are one subtree, ordered by the next trie. Only branch lengths and bytes are kept.
"""

import numpy as np

SPAN = 100
GRAM = 32
OFFSETS = SPAN - GRAM + 1
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def words_at(buf: np.ndarray, big: bool) -> np.ndarray:
    """The 8-byte word that begins at each position; past the end zeros."""
    n = len(buf)
    pad = np.zeros(n + 16 - n % 8, np.uint8)
    pad[:n] = buf
    out = np.empty(n + 8 - n % 8, np.uint64)
    m = len(out) // 8
    for r in range(8):
        out[r::8] = np.frombuffer(pad[r : r + 8 * m].tobytes(), ">u8" if big else "<u8")
    return out[:n]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each position that has as many."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    t = words_at(buf, False)
    t *= np.uint64(0x9E3779B97F4A7C15)
    t ^= t >> np.uint64(32)
    h = t[:n] * np.uint64(0xC2B2AE3D27D4EB4F)
    for i, c in enumerate((0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F), 1):
        h += t[8 * i : 8 * i + n] * np.uint64(c)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(32)
    return h


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of the anchors of texts laid end to end.

    ``ends``: each text's end. Windows are named by their start and lie within one text."""
    none = np.zeros(0, np.int64)
    h = gram_hashes(buf)
    n = len(buf) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    x = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= OFFSETS:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = OFFSETS - size
    x = np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
    valid = np.ones(n + SPAN, bool)
    begin = 0
    for e in ends.tolist():
        valid[max(begin, e - SPAN + 1) : e] = False
        begin = e
    s = np.flatnonzero(valid[:n])
    if not len(s):
        return np.zeros(0, np.uint64), none, none, none
    at = (x[s] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(s) - 1]))
    pos = at[first]
    return h[pos], pos, s[first], s[last]


def take(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ranges laid end to end, offsets of the ranges in them)."""
    offsets = np.concatenate(([0], np.cumsum(length)))
    index = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return buf[index], offsets


def _shared(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the strings at a and b, which agree up to ``depth``, at most ``cap``."""
    out = depth.copy()
    todo = np.flatnonzero(out < cap)
    while len(todo):
        d = out[todo]
        x = words[np.minimum(a[todo] + d, len(words) - 1)] ^ words[np.minimum(b[todo] + d, len(words) - 1)]
        same = np.zeros(len(todo), np.int64)
        for k in range(8):
            same += x < np.uint64(1 << 8 * k) if k else x == 0
        out[todo] = np.minimum(d + same, cap[todo])
        todo = todo[(same == 8) & (out[todo] < cap[todo])]
    return out


def deep_shallow(buf: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the strings in order within their groups, and the length each shares with
    the one before it (-1 where a group begins). All strings have ``shallow`` bytes or more;
    a string that ends is less than one that goes on. ``group`` is sorted."""
    n = len(start)
    order = np.arange(n)
    common = np.full(n, 0, np.int64)
    new = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
    common[new] = -1
    words = words_at(buf, True) if len(buf) else np.zeros(1, np.uint64)
    buf = buf if len(buf) else np.zeros(1, np.uint8)
    part = np.cumsum(new) - 1
    for depth in range(0, shallow, 8):  # partition steps
        w = words[start[order] + depth]
        if ((w[1:] == w[:-1]) | (part[1:] != part[:-1])).all():
            continue
        o = np.lexsort((w, part))
        order, w, part = order[o], w[o], part[o]
        cut = np.flatnonzero((part[1:] == part[:-1]) & (w[1:] != w[:-1])) + 1
        common[cut] = _shared(words, start[order[cut - 1]], start[order[cut]], np.full(len(cut), depth), np.full(len(cut), depth + 8))
        fresh = np.concatenate(([True], part[1:] != part[:-1]))
        fresh[cut] = True
        part = np.cumsum(fresh) - 1
    depth = np.full(n, shallow, np.int64)  # by slot: what its group is known to share
    sizes = np.bincount(part, minlength=1) if n else np.zeros(0, np.int64)
    live = np.flatnonzero(sizes[part] > 1) if n else np.zeros(0, np.int64)
    while len(live):  # blind tries, one branch around a pivot in each group and round
        p = part[live]
        head = np.concatenate(([True], p[1:] != p[:-1]))
        pivot = live[np.flatnonzero(head)][np.cumsum(head) - 1]
        a, b = order[live], order[pivot]
        cap = np.minimum(length[a], length[b])
        shared = _shared(words, start[a], start[b], depth[live], cap)
        last = len(buf) - 1
        byte = np.where(shared < length[a], buf[np.minimum(start[a] + shared, last)].astype(np.int64) + 1, 0)
        other = np.where(shared < length[b], buf[np.minimum(start[b] + shared, last)].astype(np.int64) + 1, 0)
        side = np.sign(byte - other)
        place = np.where(side < 0, shared, np.where(side > 0, SPAN * 4 - shared, 0))
        byte[side == 0] = 0
        index = np.cumsum(head) - 1
        key = ((index * 3 + side + 1) * (SPAN * 4 + 1) + place) * 257 + byte
        o = np.argsort(key, kind="stable")
        key, shared, side, byte, index = key[o], shared[o], side[o], byte[o], index[o]
        order[live] = a[o]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        inner = np.flatnonzero(fresh & ~np.concatenate(([True], index[1:] != index[:-1])))
        reach = np.where(side == 0, SPAN * 4, shared)
        common[live[inner]] = np.minimum(reach[inner - 1], reach[inner])
        ended = (side == 0) | (byte == 0)
        tied = np.flatnonzero(~fresh & ended)
        common[live[tied]] = length[order[live[tied]]]
        depth[live] = shared + 1
        part[live] = live[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        width = np.diff(np.concatenate((np.flatnonzero(fresh), [len(key)])))[np.cumsum(fresh) - 1]
        live = live[~ended & (width > 1)]
    return order, common


def later_windows(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, doc: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and greatest ``o`` (bytes left of the anchor) of its windows that
    also start earlier; (OFFSETS, -1) for none.

    Contexts are in order of (group, doc, pos). A context holds ``high`` bytes left of its anchor and
    SPAN - low from it on; its windows are those with low <= o <= high."""
    n = len(group)
    least, most = np.full(n, OFFSETS), np.full(n, -1)
    middle = offsets[:-1] + high
    right = deep_shallow(data, middle, SPAN - low, group, GRAM)
    left = deep_shallow(data[::-1], len(data) - middle, high, group, 0)
    for o in range(OFFSETS):
        has = np.flatnonzero((low <= o) & (o <= high))
        if len(has) < 2:
            continue
        names = []
        for (order, common), need in ((right, SPAN - o), (left, o)):
            name = np.empty(n, np.int64)
            name[order] = np.cumsum(common < need)
            names.append(name)
        if 2 > (counts := np.bincount(names[0][has])).max():
            continue
        has = has[counts[names[0][has]] > 1]
        key = names[0][has] * (n + 1) + names[1][has]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        f = has[first][back]
        later = has[(doc[has] != doc[f]) | (pos[has] != pos[f])]
        least[later] = np.minimum(least[later], o)
        most[later] = o
    return least, most
