"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.store import kept


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every linked node; the root is the smallest node of its component.

    Alternates two steps until nothing changes: each node links its larger neighbours to its smallest one, then its smaller
    neighbours and itself. A hub is never gathered: its smallest neighbour is an aggregate, joined back to its links.
    Links with a null and loops are ignored. No links give no rows.
    """
    link = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = kept(link.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _is_settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        wide = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        wide = kept(wide)
        low = kept(wide.groupBy("u").agg(F.min("v").alias("m")))
        near = wide.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _is_settled(e: DataFrame) -> bool:
    """Whether every node is linked to one smaller node that is linked to none."""
    chained = e.select("u").join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    torn = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    return chained.unionByName(torn).isEmpty()
