"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.session import cut_lineage


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One half step: link each node's neighbours (the larger ones, or the smaller
    ones and itself) to its smallest neighbour, or itself."""
    if small:
        sided = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        sided = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sided.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = sided.join(least, "u")
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")) if small else \
        moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) for every node that is not the smallest of its component, v being the
    smallest.  ``links`` has two columns u and v of one comparable type.

    Nodes are linked to their smallest neighbour in alternating steps until nothing
    changes, about as often as the logarithm of the longest chain.  A node with many
    links is aggregated before the shuffle and its join is split by size; each
    round is written to the shared checkpoint folder."""
    links = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u <> v").distinct())
    mark = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            return links
        mark = now
        links = cut_lineage(_stars(_stars(links, small=False), small=True))
