"""Toxicity by a weighted lexicon (operator 4).

Fold: NFKC, lower case, look-alike letters of other scripts to Latin, zero-width characters out,
digits and signs that stand for letters inside a word to those letters, everything else to one
space. Match: one Aho-Corasick automaton over whole words and word beginnings (both anchored
by spaces), with exception phrases: a hit inside an exception phrase does not count. Score: a
logistic function of the matched weights and of their share of the text's words.

Learn: lexicon weights are smoothed log-odds of document frequencies in toxic and other labelled
texts, for words and word beginnings of 4 to 9 letters; ``TERMS``, a parameter of the model, is the most
that a lexicon has, the surest first (``train(..., terms=None)`` keeps all); the logistic function is fitted on the
same texts with each text's own contribution to the counts taken out, so a term that it alone
brings gains nothing. Rows learned from: at most ``SAMPLE`` labelled rows (those with the
smallest hashes of doc_id) for which crc32(doc_id) mod 4 is not 2. Labels, lang, source and doc_id
are never inputs of a score.

Results: a null text is empty and scores as a text without hits. Repeated rows are scored each.
Without labelled rows of both kinds the model has no terms and scores every text 0. An empty table
gives no rows. Extra columns are ignored. Labels that repeat or that are null do not count twice
or at all.
"""

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Sink, arrow_schema, materialize, partitions, read, rows, text_of

#: Most labelled rows that a model is learned from.
SAMPLE = 20_000
#: Most terms of a lexicon; texts a term must be in to be one.
TERMS = 4_000
LEAST = 3
#: A term's toxic share must exceed the base rate by this log-odds.
MARGIN = 1.5
THRESHOLD = 0.3

#: Letters of other scripts that look like Latin ones, and signs for letters.
LOOKALIKES = (
    {0x430: "a", 0x432: "b", 0x435: "e", 0x456: "i", 0x458: "j", 0x43A: "k", 0x43C: "m", 0x43D: "h", 0x43E: "o", 0x440: "p", 0x441: "c", 0x442: "t", 0x443: "y", 0x445: "x", 0x455: "s", 0x501: "d", 0x51B: "q", 0x51D: "w"}
    | {0x3B1: "a", 0x3B2: "b", 0x3B3: "y", 0x3B5: "e", 0x3B9: "i", 0x3BA: "k", 0x3BD: "v", 0x3BF: "o", 0x3C1: "p", 0x3C4: "t", 0x3C5: "u", 0x3C7: "x", 0x3C9: "w"}
    | {0x251: "a", 0x261: "g", 0x131: "i"}
)
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
INVISIBLE = (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "pond scum", "loser bracket", "pathetic fallacy")

_FOLD = LOOKALIKES | dict.fromkeys(INVISIBLE, "")
_SIGNS = str.maketrans(SIGNS)
#: Runs of letters, digits and signs. Each is looked at once, so that junk takes linear time.
_RUN = re.compile(r"[\w@$!]+")
_SIGN = re.compile(r"[0134578@$!]")
_LETTER = re.compile(r"[^\W\d_]")
_GAPS = re.compile(r"[\W_]+")


def _unmasked(run: re.Match) -> str:
    """A run with letters for its digits and signs, where it has both; marks at its end stay."""
    core = run[0].rstrip("!")
    if not (_SIGN.search(core) and _LETTER.search(core)):
        return run[0]
    return core.translate(_SIGNS) + run[0][len(core) :]


def fold(text: str) -> str:
    """Folded words with one space around each."""
    t = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    if _SIGN.search(t):
        t = _RUN.sub(_unmasked, t)
    return f" {_GAPS.sub(' ', t).strip()} "


def features(folded: str) -> set[str]:
    """Words (`` word ``) and word beginnings (`` begin``) of a folded text."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for w in words:
        if not w[0].isdigit():
            out.update(f" {w[:k]}" for k in range(4, min(len(w), 9) + 1))
    return out


@dataclass
class Model:
    """Terms with their weights, exceptions, and the logistic function's coefficients."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] | None = None

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for e in self.exceptions:  # after the terms: a term of the same text gives way
            a.add_word(k := fold(e), (len(k), None))
        a.make_automaton()
        return a


def hits(automaton, folded: str) -> tuple[dict[int, float], int]:
    """Best weight of each matched word by its position, exceptions taken out; number of words."""
    found: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w is None:
            safe.append((start, end))
        elif w > found.get(start, 0.0):
            found[start] = w
    if safe and found:
        bounds: list[int] = []  # of the safe stretches, begin and end in turn
        for a, b in sorted(safe):
            if bounds and a <= bounds[-1]:
                bounds[-1] = max(b, bounds[-1])
            else:
                bounds += [a, b]
        found = {k: w for k, w in found.items() if bisect_right(bounds, k) % 2 == 0}
    return found, folded.count(" ") - 1


def inputs(found: dict[int, float], folded: str, n_words: int) -> tuple[float, ...]:
    """What the logistic function sees: strength of the hits and their share of the text."""
    best: dict[str, float] = {}
    for at, w in found.items():
        key = folded[at : folded.index(" ", at + 1)]
        best[key] = max(w, best.get(key, 0.0))
    strong = sorted(best.values(), reverse=True)
    mass = sum(found.values())
    n = max(n_words, 1)
    return (strong[0] if strong else 0.0, sum(strong[:3]), math.log1p(mass), math.log1p(100 * mass / n), math.sqrt(min(1.0, len(found) / n)))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, pen = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    pen[-1, -1] = 1e-6
    for _ in range(rounds):
        p = logistic(x @ b)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (y - p) - pen @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def weight(toxic: int, other: int, n_toxic: int, n_other: int) -> float:
    """Smoothed log-odds of a term's document frequencies."""
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))


def lexicon(counts: Iterable[tuple[str, int, int]], n_toxic: int, n_other: int, terms: int | None = TERMS) -> dict[str, tuple[int, int]]:
    """The terms worth keeping: enough toxic texts, enough log-odds; the surest ones first."""
    good = []
    for term, t, o in counts:
        if t >= LEAST and weight(t - 1, o, n_toxic, n_other) >= MARGIN:
            good.append((-weight(t, o, n_toxic, n_other) * math.sqrt(t), term, t, o))
    return {term: (t, o) for _, term, t, o in sorted(good)[:terms]}


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def is_held_out() -> Column:
    """Whether crc32 of the doc_id's text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled rows that are not held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~is_held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # SAMPLE rows of 12 bytes: broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, other) texts per term, summed up over each task's batches."""
    schema = arrow_schema("term string, toxic long, other long")
    for b in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(*[c.to_pylist() for c in b.columns], strict=True):
            counts[toxic].update(features(fold(text)))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], schema=schema)


def _own_inputs(model: Model, kept: dict[str, tuple[int, int]], n_toxic: int, n_other: int):
    """Inputs of the training texts, each with its own part of the counts taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, sink = model.automaton(), Sink(arrow_schema("a double, b double, c double, d double, e double, toxic int"))
        for text, toxic in rows(batches):
            x = fold(text)
            found, n = hits(a, x)
            own: dict[int, float] = {}
            for end, (size, w) in a.iter(x):
                start = end - size + 1
                if w is not None and start in found:
                    t, o = kept[x[start : end + 1]]
                    own[start] = max(own.get(start, 0.0), weight(t - toxic, o - (1 - toxic), n_toxic - toxic, n_other - (1 - toxic)))
            if sink.add((*inputs({k: w for k, w in own.items() if w > 0}, x, n), toxic)):
                yield from sink.flush()
        yield from sink.flush()

    return run


def train(docs: DataFrame, labels: DataFrame, terms: int | None = TERMS) -> Model:
    """The lexicon and the coefficients; ``terms`` terms (None: all) and SAMPLE input rows reach the driver."""
    sample = materialize(training_rows(docs, labels), "toxicity_sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_other:
        return Model()
    pairs = sample.select("text", F.col("toxic").cast("int").alias("toxic")).repartition(max(2, partitions(sample)))
    counts = pairs.mapInArrow(_count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    odds = lambda t: F.log((t + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_other + 1))
    good = counts.filter((F.col("t") >= LEAST) & (odds(F.col("t") - 1) >= MARGIN))
    best = good if terms is None else good.orderBy(F.desc(odds(F.col("t")) * F.sqrt("t")), "term").limit(terms)
    kept = lexicon([(r.term, r.t, r.o) for r in best.collect()], n_toxic, n_other, terms)
    model = Model({k: weight(t, o, n_toxic, n_other) for k, (t, o) in kept.items()})
    seen = pairs.mapInArrow(_own_inputs(model, kept, n_toxic, n_other), "a double, b double, c double, d double, e double, toxic int").collect()
    got = np.array(sorted(tuple(r) for r in seen))  # in one order, so that a rerun adds up to the same model
    model.coefficients = tuple(fit_logistic(got[:, :-1], got[:, -1]).tolist())
    return model


_BUILT: dict[int, tuple[Model, object]] = {}


def score_texts(model: Model, texts: Iterable[str]) -> list[float]:
    """Scores from 0 to 1. The automaton is built once per model and worker process."""
    if model.coefficients is None:
        return [0.0 for _ in texts]
    key = hash((tuple(model.terms.items()), model.exceptions))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (model, model.automaton())
    a, b = _BUILT[key][1], model.coefficients
    out = []
    for t in texts:
        x = fold(t or "")
        z = sum(c * v for c, v in zip(b, (*inputs(*_pair(a, x)), 1.0), strict=True))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def _pair(automaton, folded: str) -> tuple[dict[int, float], str, int]:
    found, n = hits(automaton, folded)
    return found, folded, n


def scorer(model: Model):
    """A column function from texts to scores."""
    import pandas as pd

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        """Toxicity score."""
        return pd.Series(score_texts(model, texts.tolist()), dtype="float64")

    return score


def op4_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
