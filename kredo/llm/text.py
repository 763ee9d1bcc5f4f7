"""Word splitting and row keys used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of other characters than these six: space, tab, line feed,
# vertical tab, form feed, carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_keys(id_: Column, text: Column) -> list[Column]:
    """Two hashes ``k1``, ``k2`` of id and text: 128 bits without nulls.  Rows that
    share them have the same id and text, so what is decided from the text holds for
    each of them."""
    return [F.xxhash64(whole(text), id_).alias("k1"), F.xxhash64(F.lit(1), id_, whole(text)).alias("k2")]
