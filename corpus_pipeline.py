"""A corpus in five stages: toxic texts go, near-duplicates go, secrets are blanked, sources are mixed
to target weights, and what is left is packed into sequences of 2048 tokens.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents, whatever
further columns there are. Every stage takes an empty table to an empty table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import mixing, packing, secrets, simhash, toxicity
from tallyloom.llm.common import materialize, read
from tallyloom.llm.tokens import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts that score below its threshold stay. The model is learned from the labels of
    the given documents. Null and empty texts score as texts without hits and stay; repeated rows are scored
    each; a score of exactly the threshold goes (there are no other ties); a very long text is scored whole, in linear time; without labels of both
    kinds every score is 0 and all stay."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(model)("text") < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each class of near-duplicates the document of the smallest doc_id stays.

    Near: fingerprints that meet at an anchor, and five-word Jaccard similarity of 0.8 or more. Null and
    empty texts are one class, repeated rows one document; an empty table stays empty."""
    return simhash.one_of_each(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: all documents stay; the value of each secret found becomes ``[SECRET]``.
    Null texts stay null; empty ones stay empty; repeated rows are redacted each; of matches that overlap the leftmost counts, rule after rule;
    a very long text is redacted whole, in linear time."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: a row for each time that the mix takes a document, in mixing order. Null and empty texts
    have no words, so the mix takes nothing of them; repeated rows are queued each; ties in finish time go
    by the hash of doc_id and text."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of all rows and their places in sequences. A null or empty text is its end id;
    repeated rows are packed each; among pieces of one length the order of rows in their worker decides; a very long text is cut into as many pieces as it
    needs."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", blank_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, fingerprints' classes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
