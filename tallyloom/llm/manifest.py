"""Merkle manifest of a dataset (operator 13), by cogrouped subtree exchange.

Every row is a leaf: the SHA-256 of its columns, each with its length. The leaves of a source, in order, make a
tree of FAN children a node; the sources' roots, in order, make a tree above. A leaf's proof is its
siblings on all levels: with them anybody folds the leaf to the root and sees that neither has changed.

1. Leaves are made by built-in functions in one pass over the texts. All that follows is narrow.
2. Leaves are numbered in their source by ranges (``numbering``), so a source of any share lies in many ranges.
3. Upwards: superblocks of FAN ** LEVELS consecutive nodes (4,096) of a tree are reduced to their top node in a group
   each; the tops are the next tier's nodes, until every source has one node. These are the sources' roots, which
   are numbered and reduced in the same way to the root.
4. Downwards, from the root's tier to the leaves: a tier's nodes and the outer nodes that their superblock requires, which
   are the siblings above its top on all levels up to the root, are cogrouped by superblock in ``applyInPandas``. The group finishes the
   local reduction, joins local and outer siblings to each node's proof, and folds. Each tier's proofs are the outer nodes
   of the tier below. All leaves of a superblock have the same outer nodes, so these are one row a superblock.

A group is at most 4,096 nodes of 64 characters and one row of 15 digests a level, whatever the source's size; tiers
are the logarithm of the row count to base 4,096, and the driver sees the largest source's row count and the number of sources.

Results: null columns are part of the digest and unlike empty ones. A null source is a source, before all others; null doc_ids come
first in theirs and are not tampered with. Rows that share source and doc_id are ordered by their leaf; rows that are alike are
leaves each. An empty table gives no rows. Columns beyond the five have no part in it.
"""

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, read
from tallyloom.llm.runs import CRC_SQL
from tallyloom.operators.numbering import number_rows

#: Children of a node, and levels of a superblock.
FAN, LEVELS = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, number long, n long, digest string"
_PROOF = "tree string, number long, subroot string, root string, places array<int>, others array<string>"
OUT = "doc string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*columns: Column) -> Column:
    """SHA-256, lowercase hexadecimal, of ``-`` for null, else the length in UTF-8 bytes, ``:`` and the value, of all columns."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c), F.lit(":"), c))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Shape:
    """Nodes have ``fan`` children, superblocks ``levels`` levels."""

    fan: int = FAN
    levels: int = LEVELS

    @property
    def block(self) -> int:
        return self.fan**self.levels

    def reduce(self, nodes: list[str], n: int) -> list[list[str]]:
        """The nodes of each level from these up, of a superblock in a tree of n nodes on its level; the last one has the top alone."""
        out = [nodes]
        while n > 1 and len(out) <= self.levels:
            out.append([_hash(out[-1][i : i + self.fan]) for i in range(0, len(out[-1]), self.fan)])
            n = -(-n // self.fan)
        return out

    def siblings(self, levels: list[list[str]], i: int) -> tuple[list[int], list[str]]:
        """(places, others): for each level the place of node i's ancestor in its run and the others of that run, joined."""
        places, others = [], []
        for nodes in levels[:-1]:
            i, place = divmod(i, self.fan)
            run = nodes[i * self.fan : (i + 1) * self.fan]
            places.append(place)
            others.append("".join(run[:place] + run[place + 1 :]))
        return places, others


def fold(leaf: str, places: list[int], others: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for p, o in zip(places, others, strict=True):
        leaf = _hash([o[: 64 * p], leaf, o[64 * p :]])
    return leaf


def _top(shape: Shape, key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("number")
    n = int(block.n.iloc[0])
    top = shape.reduce(block.digest.tolist(), n)[-1]
    return pd.DataFrame({"tree": [key[0]], "number": [key[1]], "n": [-(-n // shape.block)], "digest": top})


def _proofs(shape: Shape, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Each node's siblings up to the root: those in its superblock, then the outer ones."""
    block = block.sort_values("number")
    levels = shape.reduce(block.digest.tolist(), int(block.n.iloc[0]))
    above = outer.iloc[0]
    made = [shape.siblings(levels, i) for i in range(len(block))]
    return pd.DataFrame({
        "tree": block.tree.tolist(), "number": block.number.tolist(), "subroot": above.subroot, "root": above.root,
        "places": [p + list(above.places) for p, _ in made], "others": [o + list(above.others) for _, o in made],
    })


def _verified(shape: Shape, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The leaves' tier: proofs are digested, and each leaf, or what it became, is folded to a root."""
    block = block.sort_values("number")
    leaves = block.digest.tolist()
    levels = shape.reduce(leaves, int(block.n.iloc[0]))
    above = outer.iloc[0]
    proof, folded = [], []
    for i, (leaf, now) in enumerate(zip(leaves, block.now.tolist(), strict=True)):
        places, others = shape.siblings(levels, i)
        places, others = places + list(above.places), others + list(above.others)
        proof.append(_hash(others))
        folded.append(fold(now or leaf, places, others))
    out = pd.DataFrame({"doc": block.doc.tolist(), "leaf": leaves, "subroot": above.subroot, "root": above.root, "proof_sha256": proof, "folded_root": folded})
    return out.assign(verified=out.folded_root == out.root)


def _block(shape: Shape) -> Column:
    return F.floor(F.col("number") / shape.block).alias("block")


def _tiers(nodes: DataFrame, most: int, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """(tiers, ends): the nodes of every tier, and the one node (tree, digest, tier) that each tree ends in. ``most``: nodes of the
    largest tree. A tree leaves when one node is left; a single node is a superblock of its own."""
    tiers, ends = [nodes], None
    while True:
        grouped = tiers[-1].select("tree", "number", "n", "digest").groupBy("tree", _block(shape))
        up = materialize(grouped.applyInPandas(lambda key, block: _top(shape, key, block), _NODE), "tops")
        done = up.filter("n = 1").select("tree", "digest", F.lit(len(tiers) - 1).alias("tier"))
        ends = done if ends is None else ends.unionByName(done)
        most = -(-most // shape.block)
        if most <= 1:
            return tiers, ends
        tiers.append(up.filter("n > 1"))


def _descend(tiers: list[DataFrame], ends: DataFrame, shape: Shape, last: Callable, schema: str) -> DataFrame:
    """``last`` applied to the lowest tier's superblocks. ``ends`` has the outer nodes above each tree's end, and the end's tier."""

    def exchange(nodes: DataFrame, outer: DataFrame, work: Callable, out: str) -> DataFrame:
        pairs = nodes.groupBy("tree", _block(shape)).cogroup(outer.groupBy("tree", F.col("number").alias("block")))
        return pairs.applyInPandas(lambda block, above: work(shape, block, above), out)

    outer = ends.filter(F.col("tier") == len(tiers) - 1).drop("tier")
    for t in range(len(tiers) - 1, 0, -1):
        outer = materialize(exchange(tiers[t], outer, _proofs, _PROOF), "outer").unionByName(ends.filter(F.col("tier") == t - 1).drop("tier"))
    return exchange(tiers[0], outer, last, schema)


def manifest(docs: DataFrame, changed: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """The contract's columns, a row a document. ``changed``: what the text is when it is verified, null for no change."""
    cols = [F.col(c) for c in COLUMNS]
    now = F.when(changed.isNotNull(), digest(*cols[:4], changed)) if changed is not None else F.lit(None).cast("string")
    tree = F.concat(F.when(F.col("source").isNull(), "-").otherwise(":"), F.coalesce("source", F.lit("")))  # null first, then by bytes
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), digest(*cols).alias("digest"), now.alias("now"), F.monotonically_increasing_id().alias("row"))
    leaves = materialize(made, "leaves")
    counts = materialize(leaves.groupBy("tree").agg(F.count("*").alias("n")), "trees")
    size = counts.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    numbered = number_rows(leaves, ["tree"], ["doc_id", "digest", "row"]).join(counts, "tree")
    tiers, subroots = _tiers(numbered.select("tree", "number", "n", "digest", F.col("doc_id").cast("string").alias("doc"), "now"), size[1], shape)
    # the tree over the sources: its leaves are named by their source until they are numbered
    above = number_rows(materialize(subroots, "subroots").withColumnRenamed("tree", "source"), [], ["source"])
    top_tiers, root = _tiers(above.select(F.lit("").alias("tree"), "number", F.lit(size[0]).cast("long").alias("n"), "digest"), size[0], shape)
    start = root.select("tree", F.lit(0).cast("long").alias("number"), F.lit("").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("others"), "tier")
    proofs = materialize(_descend(top_tiers, start, shape, _proofs, _PROOF), "outer")
    ends = above.join(proofs.drop("tree", "subroot"), "number").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("number"), F.col("digest").alias("subroot"), "root", "places", "others", "tier")
    out = _descend(tiers, materialize(ends, "ends"), shape, _verified, OUT)
    return out.select(F.col("doc").cast("long").alias("doc_id"), *[c for c in out.columns if c != "doc"])


def op13_subtree_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every row of ``documents``; where 5 divides the CRC-32 of the doc_id, the row is verified with its
    text's A-Z in lower case."""
    docs = read(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, F.when(chosen, lower_ascii(F.col("text"))))


def _sql(levels: int = 6) -> str:
    """The query in DuckDB's SQL, level by level: trees of up to 16 ** levels leaves."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(part, COLUMNS[:4]))} || {part(text)})"
    ascii_lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"WITH {CRC_SQL}", f"a0 AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN h % 5 = 0 THEN {leaf(ascii_lower)} ELSE {leaf('text')} END AS cur, '' AS proof FROM documents LEFT JOIN crc USING (doc_id))"]
    ctes += ["p0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i FROM a0)", "n0 AS (SELECT source, i, leaf AS d FROM p0)"]

    def climb(n: str, p: str, by: str, k: int) -> None:
        ctes.append(f"r_{n}{k} AS (SELECT {by}i // 16 AS run, list(d ORDER BY i) AS ds, any_value(c) AS c FROM (SELECT *, count(*) OVER ({'PARTITION BY source' if by else ''}) AS c FROM {n}{k}) GROUP BY {by}i // 16)")
        ctes.append(f"{n}{k + 1} AS (SELECT {by}run AS i, CASE WHEN c > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM r_{n}{k})")
        on = ("r.source IS NOT DISTINCT FROM p.source AND " if by else "") + "r.run = p.i // 16"
        low, high = "array_to_string(ds[1 : p.i % 16], '')", "array_to_string(ds[p.i % 16 + 2 :], '')"
        ctes.append(f"{p}{k + 1} AS (SELECT p.* EXCLUDE (i, cur, proof), p.i // 16 AS i, CASE WHEN c > 1 THEN sha256({low} || cur || {high}) ELSE cur END AS cur, CASE WHEN c > 1 THEN proof || {low} || {high} ELSE proof END AS proof FROM {p}{k} p JOIN r_{n}{k} r ON {on})")

    for k in range(levels):
        climb("n", "p", "source, ", k)
    ctes.append(f"m0 AS (SELECT source, d, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i FROM n{levels})")
    ctes.append(f"q0 AS (SELECT p.* EXCLUDE (i), m.i AS i, m.d AS subroot FROM p{levels} p JOIN m0 m ON m.source IS NOT DISTINCT FROM p.source)")
    for k in range(levels):
        climb("m", "q", "", k)
    return ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = d AS verified FROM q{levels}, m{levels}"


OP13_SQL = _sql()
