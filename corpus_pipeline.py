"""From raw documents to token ids: five stages, each one of the operators.

Each stage works on all its predecessor kept.  ``run`` writes a stage's result as
Parquet into the shared folder and reads it again, so that a lost executor costs no
more than the stage at work.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kredo.llm import bpe, line_dedup, mixing, quality, simhash
from kredo.session import checkpoint_dir
from kredo.sources.tables import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def without_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines dropped but for their first occurrence; documents of which
    nothing is left go, as all they say stands in others."""
    return line_dedup.drop_recurring_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return simhash.keep_first_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target words; a document comes again if its source
    gives more words than it has."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the text they decode to."""
    done = bpe.encode_decode(docs, TOKENIZER)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", good), ("line dedup", without_lines), ("simhash near-dedup", one_of_each),
          ("mixing", mixed), ("bpe", encoded)]

# SQL has no SimHash or BPE.  tests/llm hold the stages against brute force (quality rules,
# SimHash, BPE), all pairs (line dedup: recall) and their targets (mixing).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
