"""Token ids with the ``tokenizers`` library, through a bounded cache of chunks.

Both vocabularies split a text before merging bytes, and no split unit crosses the edge
between a chunk and the next: a chunk is a run of non-space characters, with one leading
space where the vocabulary keeps spaces. So a text's ids are its chunks' ids in a row, and
each worker asks the library once for chunks that it has not seen, many at a time. Texts
with the separators U+001C to U+001F (on which Python and the library disagree) or with
what may be a special token's string go to the library whole.
"""

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in each of a worker's two generations of cache; about 200 bytes each. A full generation
#: becomes the old one; chunks that are met again move on to the new one.
CACHE = 400_000
#: Unseen chunks given to the library in one text; texts looked up at a time.
GROUP = 200
SLICE = 256
RUN = 2048
#: Letters below this code point are letters to Python and to the library alike.
LATIN = "\u0250"

#: What a plain text does not have: white space but single spaces and newlines inside, special tokens.
NOT_PLAIN = r"[\t\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\||[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
#: Texts with one of these are not split.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")

_LOADED: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder per worker process and file; its cache outlives tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.newline = line[0] if line else None  # None: white space is dropped
        self.chunks = str.split if self.newline is None else re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        self.tok.model._resize_cache(0)  # unseen chunks only: the library's own cache costs more than it saves
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.punct: dict[str, bytes] = {c: self.whole(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new chunks into the cache, many chunks a text for the library. A word with
        one mark at its end is the word and the mark, to both vocabularies, where it is letters alone
        and stays so in lower case (a dotted capital I does not: its dot would go with the mark);
        where white space is dropped, letters are lower-cased too."""
        cache, old = self.cache, self.old
        rest = []
        for c in new:
            ids = old.get(c)
            if ids is None and c[-1] in ".,":
                stem = c[:-1]
                if stem.lstrip(" ").lower().isalpha() and max(stem) < LATIN:
                    ids = cache.get(stem) or old.get(stem)
                    ids = ids and ids + self.punct[c[-1]]
            if ids is None and self.newline is None and c.isascii():
                low = c.lower()
                ids = cache.get(low) or old.get(low)
            if ids is None:
                rest.append(c)
            else:
                cache[c] = ids
        new = rest
        if self.newline is not None:
            for c in [c for c in new if c.isspace()]:
                cache[c] = self.whole(c)
            new = [c for c in new if not c.isspace()]
        groups = [new[i : i + GROUP] for i in range(0, len(new), GROUP)]
        for at in range(0, len(groups), 256):
            some = groups[at : at + 256]
            texts = ["\n".join(g) for g in some]
            if self.newline is not None:
                for g, e in zip(some, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, "<u4")
                    ends = (4 * np.flatnonzero(ids == self.newline)).tolist()
                    raw, b = ids.tobytes(), 0
                    for c, x in zip(g, [*ends, len(raw)], strict=True):
                        cache[c] = raw[b:x]
                        b = x + 4
            else:
                for g, e in zip(some, self.tok.encode_batch(texts, add_special_tokens=False), strict=True):
                    raw = np.array(e.ids, "<u4").tobytes()
                    begins = np.cumsum([0, *[len(c) + 1 for c in g]])
                    at_ids = (4 * np.searchsorted(np.array([o[0] for o in e.offsets] or [0])[: len(raw) // 4], begins)).tolist()
                    for c, b, x in zip(g, at_ids[:-1], at_ids[1:], strict=True):
                        cache[c] = raw[b:x]

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` for an Arrow string array. Plain texts (single spaces or newlines between words,
        none at an end) are split and numbered in Arrow; Python sees each distinct piece once a run."""
        for at in range(0, len(texts), RUN):
            part = texts.slice(at, RUN)
            plain = pc.invert(pc.match_substring_regex(part, NOT_PLAIN))
            mask = plain.to_numpy(zero_copy_only=False)
            fast = iter(self._plain(part.filter(plain)) if mask.any() else ())
            slow = self.encode(part.filter(pc.invert(plain)).to_pylist())
            for m in mask.tolist():
                yield next(fast if m else slow)

    def _plain(self, texts: pa.Array) -> Iterator[bytes]:
        """Where spaces count, a piece is a word after a space, or after a newline that it keeps; the
        text's first word gets a newline that is taken off its ids."""
        keep = self.newline is not None
        marked = pc.binary_join_element_wise("\n", texts, "") if keep else texts
        split = pc.split_pattern(pc.replace_substring(marked, "\n", " \n" if keep else " "), " ")
        ends = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_pylist()
        names = [p if p[:1] == "\n" else f" {p}" for p in pieces] if keep else pieces
        raws = self._known([n.lstrip("\n") for n in names]) if keep else self._known(names)
        if keep:
            line = np.array([self.newline], "<u4").tobytes()
            raws = [line + r if n[:1] == "\n" else r for n, r in zip(names, raws, strict=True)]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        ids = np.frombuffer(b"".join(raws), "<u4")
        begins = np.cumsum(sizes) - sizes
        which = numbered.indices.to_numpy()
        n = sizes[which]
        at = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat(begins[which] - at[:-1], n) + np.arange(at[-1])]
        skip = 2 if keep else 0  # marked texts begin with an empty piece (a lone space) and a newline
        for a, b in zip(at[ends[:-1]].tolist(), at[ends[1:]].tolist(), strict=True):
            yield out[a + skip : b].tobytes()

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, from the cache or the library."""
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        got = list(map(self.cache.get, chunks))
        if None in got:
            holes = [i for i, g in enumerate(got) if g is None]
            self._learn(list({chunks[i] for i in holes}))
            for i in holes:
                got[i] = self.cache[chunks[i]]
        return got

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        texts = list(texts)
        for at in range(0, len(texts), SLICE):
            yield from self._slice(texts[at : at + SLICE])

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        odd = [any(x in t for x in ODD) for t in texts]
        flat: list[str] = []
        ends = [0]
        for t, o in zip(texts, odd, strict=True):
            if not o:
                flat += self.chunks(t)
            ends.append(len(flat))
        got = self._known(flat)
        for t, o, a, b in zip(texts, odd, ends, ends[1:], strict=False):
            yield self.whole(t) if o else b"".join(got[a:b])
