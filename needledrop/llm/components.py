"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.sources.store import fingerprint, settled


def _smallest(links: DataFrame, key: str, other: str) -> DataFrame:
    """(u, m): the smallest of a node and its neighbours, written so that a hot node's join can be split."""
    found = links.groupBy(F.col(key).alias("u")).agg(F.min(other).alias("m"))
    return settled(found.select("u", F.least("u", "m").alias("m")), "smallest")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; ``links`` has the columns a and b, root is the smallest node.

    Each round joins every node with the smallest node near it. Rounds grow with the logarithm of the
    longest chain; each is written to the shared folder, so lineage stays short and no link, label or
    component reaches the driver.
    """
    clean = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    stars = settled(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := tuple(fingerprint(stars).first())) != before:
        before = now
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        large = both.join(_smallest(both, "u", "v"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = settled(large.distinct(), "large-stars")
        small = large.join(_smallest(large, "a", "b").withColumnRenamed("u", "a"), "a")
        small = small.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        stars = settled(small.where("a <> b").distinct(), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select("b", "b").distinct()
    )
