"""URL rules by a sort-merge range join on reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows of one sweep: the URLs of a host are spread over sweeps of about so many.
SWEEP_ROWS = 256
SALTS = 64               # keys over which the URLs of one domain are dealt to meet its rules

# (host, path, verdict) of the rules that the query is asked to apply; fixed values.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A rule list as a table (host, path, verdict).  Longer lists come as a table."""
    def quoted(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict").where("false")
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(map(quoted, r))})" for r in rules)
                     + " AS t(host, path, verdict)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, and what follows up to ``?``, ``#`` or the end; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = DEFAULT, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """One row per input row: id, host, path, ``rule`` (host and path of the longest
    rule that fits, else null) and ``verdict``.

    A rule's key is its reversed host, a slash, and its path, so it covers the
    interval of all keys that start with it; a URL has one key for itself and each
    parent domain that some rule names.  Intervals of one host are nested or apart:
    each rule carries the stack of rules around it, and a sweep over rules and
    distinct URLs in key order hands each URL the stack of the last rule opened
    before it.  Rules on that stack which no longer cover the URL are popped; the
    top of what is left is the longest rule of that host.  The longest over all
    hosts wins, by characters of host and path; equal rules with both verdicts
    block.

    URLs of one host are dealt over as many sweeps as its distinct paths need, each
    with a copy of that host's rules, and at most about one rule row for each URL.
    URLs whose domains no rule names take part in no sweep.

    Null urls and those without ``://`` have empty host and path and match no rule
    unless one has an empty host.  Repeated urls are swept once.  Without rules, or
    rows, all get the default or nothing."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})

    known = (rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
                          F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
             .withColumn("rev", _reversed(F.split("host", r"\.")))
             .withColumn("rule", F.struct(F.length(F.concat("host", "path")).alias("len"),
                                          F.concat("host", "path").alias("rule"), "path", "verdict")))
    # the stack around each rule: an equal key for each of its path's prefixes
    around = (known.select("rev", F.col("path").alias("inner"),
                           F.explode(F.expr("transform(sequence(0, length(path)), n -> left(path, n))")).alias("path"))
              .join(known.select("rev", "path", "rule"), ["rev", "path"])
              .groupBy("rev", "inner").agg(F.array_sort(F.collect_list("rule")).alias("stack")))
    deepest = around.agg(F.max(F.size(F.split("rev", r"\.")))).first()[0] or 0

    urls = rows.groupBy("host", "path").count().drop("count")
    domains = F.expr(f"""transform(sequence(1, least(size(split(host, '[.]')), {max(1, deepest)})),
        n -> array_join(reverse(slice(split(host, '[.]'), -n, n)), '.'))""")
    # most URLs may share one domain: it is dealt over SALTS keys, with a copy of its rule row for each
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = around.groupBy("rev").agg(F.count(F.lit(1)).alias("n_rules")).select("*", salts)
    salted = urls.select("host", "path", F.expr(f"pmod(xxhash64(path, host), {SALTS})").cast("int").alias("salt"),
                         F.explode(domains).alias("rev"))
    keys = salted.join(named, ["rev", "salt"])
    sweeps = keys.groupBy("rev").agg(
        F.expr(f"CAST(ceil(count(1) / greatest({int(sweep_rows)}, max(n_rules))) AS INT)").alias("n_sweeps"))

    empty = F.lit(None).cast(around.schema["stack"].dataType)
    swept = keys.join(sweeps.select("*", salts), ["rev", "salt"]).select(
        "rev", F.expr("pmod(xxhash64(host, path), n_sweeps)").cast("int").alias("sweep"), "path",
        F.lit(1).alias("kind"), "host", empty.alias("stack"))
    opened = around.join(sweeps, "rev").select(
        "rev", F.explode(F.expr("sequence(0, n_sweeps - 1)")).alias("sweep"), F.col("inner").alias("path"),
        F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    in_order = Window.partitionBy("rev", "sweep").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (swept.unionByName(opened)
             .withColumn("stack", F.last("stack", ignorenulls=True).over(in_order))
             .where("kind = 1 AND stack IS NOT NULL")
             .select("host", "path", F.expr("try_element_at(filter(stack, r -> startswith(path, r.path)), -1)").alias("top"))
             .where("top IS NOT NULL")
             .groupBy("host", "path").agg(F.max("top").alias("top")))
    return rows.join(found, ["host", "path"], "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
