"""Recurring lines, found as templates in a tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.llm import bloom
from kredo.llm.scratch import Scratch
from kredo.llm.text import row_keys, whole

DEPTH = 3          # leading tokens below the token count
MIN_SHARE = 0.8    # of a line's tokens after the leading ones that must equal a template of its leaf
MIN_DOCS = 2       # documents in which a template recurs
SURE_WORDS = 8     # literal words; a generalised template of fewer recurs in one document more
# a token with a digit, matched from its start
NUMBERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line with words: row keys, number, text."""
    text = whole(F.col(text_col))
    # with one kind of space left, lines are split and judged without a pattern
    other = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    spaced = F.when(other, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    return (docs.select(F.col(id_col).alias("id"), *row_keys(F.col(id_col), F.col(text_col)),
                        F.posexplode(F.split(spaced, "\n")).alias("no", "raw"))
            .where(F.trim("raw") != ""))


def _lines(raw: DataFrame, depth: int, min_share: float) -> DataFrame:
    """Lines parsed: row keys, number, masked tokens, ``leaf``, ``line``, ``exact``,
    ``literals``.

    Only a line with two literal words, which are at least half of its tokens, is
    masked; ``exact`` is the unmasked line where that differs.  ``leaf`` is null for
    lines that are too short to differ in a token."""
    raw, numbered = raw.withColumn("numbered", F.col("raw").rlike("[0-9]")), F.col("numbered")
    masked = F.when(numbered, F.regexp_replace("raw", NUMBERED, "<*>")).otherwise(F.col("raw"))
    # most tokens begin with a letter, which is told without a pattern
    literals = F.size(F.filter("tokens", lambda t: ((t >= "a") & (t < "{")) | ((t >= "A") & (t < "[")) | t.rlike(r"\p{L}")))
    wordy = (F.col("literals") >= 2) & (2 * F.col("literals") >= F.size("tokens"))
    whole_line = F.xxhash64(F.array_remove(F.split("raw", " "), ""))
    return (raw.withColumn("tokens", F.array_remove(F.split(masked, " "), ""))
            .withColumn("literals", literals).withColumn("wordy", wordy)
            .select("id", "k1", "k2", "no", "tokens",
                    F.when(F.col("wordy") & (_may_differ(F.size("tokens"), depth, min_share) > 0),
                           F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))).alias("leaf"),
                    F.when(F.col("wordy") | ~numbered, F.xxhash64("tokens")).otherwise(whole_line).alias("line"),
                    F.when(F.col("wordy") & numbered, whole_line).alias("exact"),
                    F.least("literals", F.lit(1000)).cast("short").alias("literals")))


def _may_differ(size, depth: int, min_share: float):
    """Tokens after the leading ones in which a line may differ from its template."""
    return F.floor((size - depth) * F.lit(1 - min_share) + F.lit(1e-9)).cast("int")


def _several(members: DataFrame) -> DataFrame:
    """The members of buckets with two different lines."""
    many = members.groupBy("bucket").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("bucket")
    return members.join(many, "bucket", "left_semi")


def _buckets(different: DataFrame, depth: int, min_share: float) -> DataFrame:
    """(bucket, leaf, line, hashes): lines of a leaf that share a segment.

    The tokens after the leading ones are cut into one segment more than may differ,
    so that two lines of one template share a segment at least.  Of buckets with the
    same lines one is enough."""
    k, rest = _may_differ(F.size("hashes"), depth, min_share), f"(size(hashes) - {depth})"
    cut = different.withColumn("k", k).select("leaf", "line", F.explode(F.expr(
        f"""transform(sequence(0, k), i -> xxhash64(leaf, i, slice(hashes, {depth} + 1 + i * {rest} div (k + 1),
            (i + 1) * {rest} div (k + 1) - i * {rest} div (k + 1))))""")).alias("bucket"))
    alike = (cut.groupBy("bucket", "leaf").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("line").alias("x"),
                                               F.bit_xor(F.xxhash64("line")).alias("y"))
             .where("n > 1").groupBy("leaf", "n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"))
    return cut.join(alike, "bucket", "left_semi").join(different, ["leaf", "line"])


def _adopted(raw: DataFrame, lines: DataFrame, scratch: Scratch, depth: int, min_share: float) -> DataFrame:
    """Distinct lines (leaf, line) with the ``shared`` template that they take and
    in how many tokens they ``differ`` from it.

    Only leaves with two different lines can generalise.  A Bloom filter of the places
    of their lines picks these in a second scan, so that few lines are parsed again and
    few texts are shuffled; lines of a leaf meet in buckets.  The template of a bucket has
    at each position the token that most of its lines have there; a line fits if
    ``min_share`` of its tokens after the leading ones agree, and takes the template that
    most lines fit.  The lines left over go on to the next round.  A bucket whose template
    fits fewer than two lines is split by the token at which its lines have the fewest
    values.  Every round takes lines away or splits a bucket, until no bucket has two
    lines; a round's tables are deleted once the next one has its own."""
    several = scratch.keep(lines.where("leaf IS NOT NULL").groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b"))
                           .where("a <> b").select("leaf"))
    place = F.xxhash64("k1", "k2", "no").alias("place")
    # filters are read by two joins each: written, they are not worked out twice
    leaves = scratch.keep(bloom.filter_of(several, "leaf"))
    wanted = bloom.maybe_in(lines.where("leaf IS NOT NULL"), "leaf", leaves).where("_maybe").select(place)
    places = scratch.keep(bloom.filter_of(wanted, "place"))
    probed = bloom.maybe_in(raw.withColumn("place", place), "place", places).where("_maybe")
    # a generator holds back filters on what is parsed, which else go below the probe
    probed = probed.select("id", "k1", "k2", "no", F.explode(F.array("raw")).alias("raw"))
    different = (_lines(probed, depth, min_share).where("leaf IS NOT NULL")
                 .select("leaf", "line", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
                 .groupBy("leaf", "line", "hashes").count().drop("count"))
    different = scratch.keep(different.join(several, "leaf", "left_semi"))
    members = scratch.keep(_buckets(different, depth, min_share))
    equal = F.expr(f"size(filter(zip_with(hashes, template, (x, t) -> x = t.token), e -> e)) - {depth}")
    done = None
    while done is None or not members.isEmpty():
        modes = (members.select("bucket", F.posexplode("hashes").alias("at", "token"))
                 .groupBy("bucket", "at", "token").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("bucket", "at").agg(F.max(F.struct("n", "token")).alias("most"), F.count(F.lit(1)).alias("values"))
                 .groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("at", "most.token"))).alias("template"),
                                        F.min(F.when(F.col("values") > 1, F.struct("values", "at"))).alias("split")))
        tried = scratch.keep(members.join(modes, "bucket")
                             .withColumn("equal", equal)
                             .withColumn("fits", F.col("equal") >= min_share * (F.size("hashes") - depth) - F.lit(1e-9))
                             .withColumn("by", F.element_at("hashes", F.col("split.at") + 1))
                             .select("bucket", "leaf", "line", "hashes", "equal", "fits", "by"))
        fitted = tried.groupBy("bucket").agg(F.count_if("fits").alias("n_fit")).where("n_fit > 1")
        judged = tried.join(fitted, "bucket", "left")
        took = scratch.keep(judged.where("fits AND n_fit IS NOT NULL").groupBy("leaf", "line")
                            .agg(F.max(F.struct("n_fit", "bucket", (F.size("hashes") - depth - F.col("equal")).alias("differ"))).alias("best"))
                            .select("leaf", "line", F.xxhash64(F.lit("shared"), "best.bucket").alias("shared"), "best.differ"))
        left = judged.join(took, ["leaf", "line"], "left_anti").withColumn(
            "bucket", F.when(F.col("n_fit").isNull(), F.xxhash64("bucket", "by")).otherwise(F.col("bucket")))
        # a bucket that goes on after a round must not give its name to a second template
        rest = scratch.keep(_several(left.select(F.xxhash64(F.lit("next"), "bucket").alias("bucket"), "leaf", "line", "hashes")))
        scratch.drop(members, tried)
        members = rest
        done = took if done is None else done.unionByName(took)
    scratch.drop(different, members)
    return done


def _recurring(placed: DataFrame, min_docs: int) -> DataFrame:
    """Templates with their first occurrence and number of documents, from ``min_docs``."""
    return (placed.groupBy("template", "k1", "k2").agg(F.min(F.struct("id", "k1", "k2", "no")).alias("first"),
                                                       F.min("words").alias("words"))
            .groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first"), F.min("words").alias("words"))
            .where(F.col("n_docs") >= min_docs)
            .select("template", "n_docs", "words", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"),
                    F.col("first.no").alias("fno")))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                    min_share: float = MIN_SHARE, min_docs: int = MIN_DOCS, sure_words: int = SURE_WORDS) -> DataFrame:
    """Row keys with the sorted numbers (from 0) of their lines to drop.

    Lines are the parts between line feeds.  A token with a digit is a variable
    field in lines that consist of words for the greater part; others recur only as
    they are.  The tree sorts lines by token count, then ``depth`` leading tokens, to a
    leaf; a leaf's templates generalise the tokens in which its lines differ, and a
    line too far from all is a template of its own.  A template that occurs in
    ``min_docs`` documents recurs, a generalised one of fewer than ``sure_words``
    literal words in one document more: its first occurrence (smallest id, a null one
    first) stays and all others are dropped, so that no content goes altogether.

    Rows with the same id and text count as one document.  Lines without words are
    never dropped."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    raw = _raw_lines(docs, id_col, text_col)
    lines = scratch.keep(_lines(raw, depth, min_share).drop("tokens"))
    adopted = _adopted(raw, lines, scratch, depth, min_share)
    # a line that stands in one document and takes no template is of no more concern
    repeated = (lines.groupBy("line").agg(*[f(k).alias(f"{n}_{k}") for k in ("k1", "k2") for n, f in (("min", F.min), ("max", F.max))])
                .where("min_k1 <> max_k1 OR min_k2 <> max_k2" if min_docs > 1 else "true").select("line"))
    concern = scratch.keep(bloom.filter_of(repeated.unionByName(adopted.select("line")), "line"))
    concerned = bloom.maybe_in(lines, "line", concern)
    general = F.col("shared").isNotNull() | F.col("exact").isNotNull()
    placed = scratch.keep(
        concerned.where("_maybe").join(adopted, ["leaf", "line"], "left")
        .select("id", "k1", "k2", "no", F.coalesce("shared", "line").alias("template"),
                F.when(general, F.coalesce("exact", "line")).alias("exact"),
                F.when(general, F.col("literals") - F.coalesce("differ", F.lit(0))).alias("words")))
    recurring = _recurring(placed, min_docs)
    unsure = (F.col("n_docs") == min_docs) & F.coalesce(F.col("words") < sure_words, F.lit(False))
    # what generalised templates of too few documents leave: exact repeats
    exact = (placed.join(recurring.where(unsure).select("template"), "template", "left_semi")
             .select("id", "k1", "k2", "no", F.col("exact").alias("template"), "words"))
    first = "NOT (k1 = f1 AND k2 = f2 AND no = fno)"
    dropped = (placed.join(recurring.where(~unsure), "template").where(first).select("k1", "k2", "no")
               .unionByName(exact.join(_recurring(exact, min_docs), "template").where(first).select("k1", "k2", "no")))
    return dropped.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("no")).alias("dropped"))


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """One row per document: ``row`` (its columns as they came), ``kept_text``,
    ``n_lines``, ``n_dropped``.

    A null text has one empty line, which stays; an empty table gives an empty one."""
    dropped = recurring_lines(docs, id_col, text_col, **named)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_keys(F.col(id_col), F.col(text_col)))
    text = whole(F.col(f"row.{text_col}"))
    rows = rows.join(dropped, ["k1", "k2"], "left").withColumn("lines", F.split(text, "\n"))
    left = """array_join(transform(array(lines), l -> transform(
        array_except(sequence(0, size(l) - 1), dropped), i -> l[i]))[0], '\\n')"""
    return rows.select(
        "row", F.when(F.col("dropped").isNull(), text).otherwise(F.expr(left)).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         length_col: str | None = "n_chars", **named) -> DataFrame:
    """The documents with their text reduced, in the input's columns.  Documents of
    which no line with words is left go: all they said stands in others."""
    done = without_recurring_lines(docs, id_col, text_col, **named)
    done = done.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_dropped") == 0))
    new = {text_col: F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col(f"row.{text_col}"))}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema[length_col].dataType)) \
            .otherwise(F.col(f"row.{length_col}"))
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
