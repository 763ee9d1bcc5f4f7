"""Exact duplicates: two passes over the texts with a Bloom filter between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.llm import bloom
from kredo.llm.text import whole


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     bits: int = bloom.BITS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical.  Of equal texts the row with the largest id
    stays.  Pass one counts hashed texts into a Bloom filter of bits that two rows
    fall on; in pass two only the rows whose bits are all set are shuffled, by
    digest, and the rest pass straight through as groups of one.  The filter has a
    fixed size: when a corpus fills it, more rows shuffle and the result is the same.

    Null texts equal empty ones.  A group whose ids are all null has a null keep_id
    and keeps all its rows, as do rows that share the largest id: ids are taken as
    unique.  An empty table gives an empty one.  Other columns are not read."""
    base = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    hashed = base.withColumn("_h", F.xxhash64("_text"))
    seen = bloom.repeated_filter(hashed.select("_h"), "_h", bits)
    probed = bloom.maybe_in(hashed, "_h", seen, bits=bits).select(
        "_id", "_maybe", F.sha2("_text", 256).alias("_sha"))

    maybe = probed.where("_maybe").select("_id", "_sha")
    groups = maybe.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    shuffled = maybe.join(groups, "_sha").select("_id", "keep_id", "group_size", "_sha")
    alone = probed.where("NOT _maybe").select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_sha")
    return alone.unionByName(shuffled).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with all their columns: of rows that
    share an id each goes or stays with its own text."""
    gone = (exact_duplicates(docs, id_col, text_col).where("NOT kept")
            .select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha")).distinct())
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")) & (F.sha2(whole(F.col(text_col)), 256) == F.col("_sha")), "left_anti")
