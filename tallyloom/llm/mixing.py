"""Mixing sources to target weights by weighted fair queueing (operator 8). Built-in functions only.

Targets: sources by code point (null last) weigh 5, 2, 1 in turn and share 150 % of all words.
A target stops at twice its source's size; what is over is shared again by weight. In closed form:
with sources by cap over weight ascending, source j is capped when the level reached with the
j-1 before it capped exceeds its own ratio; one pass over a table of sources.

Queue: each source's documents are shuffled by a hash of doc_id and text and queued twice, one pass after the
other. A queued document's virtual finish time is its source's words up to its end over its source's
target. As packets do in a network, a long document waits in slices of ``QUANTUM`` words, each with the finish
time of its own end, so that no source runs further ahead of its target than that. The slices are sorted
by finish time over all sources, and the mix is what comes before the total budget (the sum of the targets).

The global sort is by ranges: all sources are served at the rates of their targets, so equal steps of virtual
time hold equal numbers of words. A range of about ``RANGE`` words is sorted in a task; the totals of
ranges, a row each, give its first position; ranges beyond the budget are not sorted.

Running sums inside a source are two-level: sums per (source, slice of the hash), then within a slice. A
source with a third of all rows is many slices, each of about ``SLICE`` rows. Rows equal in doc_id and
text share a slice.

Results: a null text has 0 words; size 0 takes 0. Null sources are one source. Repeated rows are
queued each. With no words at all every target is 0. An empty table gives no rows. Extra columns are
ignored, and kept by ``mix``.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, materialize, partitions, read, text_of

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
SEED = "mix"
SLICE = 2_000
QUANTUM = 128
RANGE = 1_000_000


def word_count() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size). Its windows see a row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", (F.col("source_size") * cap).cast("double"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"all": F.sum("source_size").over(every) * F.lit(budget), "w_all": F.sum("w").over(every), "cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(order), F.lit(0.0))})
    s = s.withColumn("capped", (F.col("all") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")) > F.col("cap") / F.col("w"))
    zero = F.lit(0.0)
    s = s.withColumns({"cap_sum": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(zero)).over(every), "w_free": F.sum(F.when(F.col("capped"), zero).otherwise(F.col("w"))).over(every)})
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("all") - F.col("cap_sum")) / F.col("w_free") * F.col("w")).alias("target"))


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    """(row, doc, source, size, hash): what the queue needs of each row, without its text."""
    doc = F.col("doc_id").cast("long")
    name = F.concat(F.lit(seed), F.coalesce(doc.cast("string"), F.lit("null")), F.lit("/"), text_of())
    return docs.select("row", doc.alias("doc"), "source", word_count().alias("size"), F.md5(name.cast("binary")).alias("hash"))


def queue(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """The written table ``_sizes`` with ``start`` (words of its source queued before it), source_size and target."""
    digits = max(1, math.ceil(math.log(max(narrow.count(), 1) / SLICE, 16))) if SLICE else 1
    piece = F.substring("hash", 1, digits)
    key = F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.lit("/"), piece)
    sums = narrow.groupBy("source", piece.alias("slice"), key.alias("key")).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("s"), "key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    t = source_targets(narrow.select("source", "size"), weights, budget, cap).withColumnRenamed("source", "t")
    heads = bases.join(t, F.col("s").eqNullSafe(F.col("t"))).drop("t", "s")
    inside = Window.partitionBy("key").orderBy("hash", "doc", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = narrow.withColumn("key", key).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(heads, "key").withColumn("start", F.col("base") + F.col("within")).drop("key", "base", "within")


def served(queued: DataFrame, cap: int = CAP) -> DataFrame:
    """(row, pass, words, at): what the truncated mix takes of each queued document, and its first position in it.

    ``queued`` is a written table."""
    budget = queued.select("source", "source_size", "target").distinct().agg(F.sum("target").alias("budget")).first()
    total = math.floor(budget.budget or 0)
    ranges = max(1, math.ceil(total / RANGE))
    n = F.col("n").cast("long")
    waiting = queued.filter("size > 0").select("row", "hash", "doc", "size", "start", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("pass"))
    slices = waiting.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / QUANTUM))))
    words = F.least(F.lit(QUANTUM), F.col("size") - F.col("slice") * QUANTUM).cast("long")
    end = F.col("start") + F.col("source_size") * F.col("pass") + F.col("slice") * QUANTUM + F.col("n")
    timed = slices.withColumn("n", words).withColumn("finish", end / F.col("target"))
    timed = timed.select("row", "hash", "doc", "pass", "slice", n.alias("n"), "finish", F.floor(F.col("finish") * ranges).alias("range"))
    totals = materialize(timed.groupBy("range").agg(F.sum("n").alias("n")), "ranges")
    bases = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")).filter(F.col("base") < total)
    order = Window.partitionBy("range").orderBy("finish", "hash", "doc", "row", "pass", "slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = timed.join(bases, "range").withColumn("at", F.col("base") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    mix = placed.filter(F.col("at") < total).withColumn("n", F.least(n, F.lit(total) - F.col("at")))
    return mix.groupBy("row", "pass").agg(F.sum("n").alias("words"), F.min("at").alias("at"))


def taken(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row per document."""
    numbered = docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    q = materialize(queue(materialize(_sizes(numbered, seed), "sizes")), "queue")
    sums = served(q).groupBy("row").agg(F.sum("words").cast("long").alias("taken"))
    return q.join(sums, "row", "left").select(F.col("doc").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``, in the queue's order: a row for each time that a
    document is taken, by its first position. A document that the cut falls into keeps its first words."""
    names = docs.columns
    kept = docs.select("doc_id", "source", "text", *[F.col(c).alias(f"__in_{k}") for k, c in enumerate(names) if c.lower() != "text"])
    base = materialize(kept.withColumn("row", F.monotonically_increasing_id()).withColumn("__size", word_count()), "numbered")
    places = materialize(served(materialize(queue(materialize(_sizes(base, seed), "sizes")), "queue")), "served")
    parts = partitions(docs)
    last = places.agg(F.max("at")).first()[0] or 0
    to = places.select("row", "pass", "words", "at", F.floor(F.col("at") * parts / F.lit(last + 1)).cast("int").alias("__to"))
    taken_rows = base.join(to, "row")
    whole = F.col("words") == F.col("__size")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("words").cast("int")), " ")
    # copies of a range of positions meet in a task, in order: the ranges are known, so nothing is sampled
    ready = taken_rows.repartitionById(parts, "__to").sortWithinPartitions("at").withColumn("__text", F.when(whole, F.col("text")).otherwise(cut))
    out = {c: F.col("__text") if c.lower() == "text" else F.when(whole, F.col(f"__in_{k}")).otherwise(F.length("__text").cast("long")) if c.lower() == "n_chars" else F.col(f"__in_{k}") for k, c in enumerate(names)}
    return ready.select(*[v.alias(c) for c, v in out.items()])


def op8_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents"))


OP8_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
b AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS a, sum(w) OVER () AS w_all, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (a - cap_before) / (w_all - w_before) > cap / w AS capped FROM b),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (a - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () * w END AS target FROM c),
q AS (SELECT row_number() OVER () AS rid, d.doc_id, d.size, d.h, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, unnest([0, 1]) AS pass FROM q WHERE size > 0),
z AS (SELECT *, unnest(range(0, (size - 1) // QUANTUM + 1)) AS slice FROM p),
n AS (SELECT rid, h, doc_id, pass, slice, least(QUANTUM, size - slice * QUANTUM) AS n, CAST(start + source_size * pass + slice * QUANTUM + least(QUANTUM, size - slice * QUANTUM) AS DOUBLE) / target AS finish FROM z),
g AS (SELECT rid, n, coalesce(sum(n) OVER (ORDER BY finish, h, doc_id, pass, slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM n),
k AS (SELECT rid, sum(greatest(least(n, (SELECT floor(sum(target)) FROM t) - pos), 0)) AS taken FROM g GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (rid)""".replace("QUANTUM", str(QUANTUM))
