"""Documents to token ids in five stages, each one an operator of ``sievespark.llm``.

Toxic documents go, one document of each near-duplicate class stays, documents with benchmark passages go,
secrets are masked, and what is left is encoded. Stages that filter look at each document's own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm import bpe, decontaminate, near_copies, secrets, simhash, toxicity
from sievespark.llm.common import materialize, read_table

VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the held-out part, doesn't reject."""
    return toxicity.clean_rows(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class.

    SimHash with pigeonring chains over 5-word shingles joins copies at two bits or fewer; what it leaves is joined
    where 80 % of the 5-word shingles or more are the same, which 64 bits tell apart too coarsely.
    """
    once = materialize(simhash.representatives(docs, shingle=5), "simhash-representatives")
    return near_copies.representatives(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind of secret; ``n_chars`` follows the text."""
    words = secrets.dictionary(public_tokenizers.path(VOCABULARY))
    masked = secrets.redact(docs, words, secrets.train(spark, words))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)`` of every document."""
    found = bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY))
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]
#: The classifiers and the edit distance cannot be said in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over the whole ``documents`` table, each but the last written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
