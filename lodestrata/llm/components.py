"""Connected components of a table of links, by alternating large and small stars.

Each round halves the height of the trees that the links form, so the number of rounds grows with the logarithm of the
longest chain. Minima are aggregated before the shuffle and joined back, so a node with very many links is never one
task's whole work. Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import written


def _least(sym: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its neighbours."""
    m = sym.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    return sym.join(m, sym["u"] == m["_u"]).drop("_u")


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, component) for every node with a link to another; component is its least node."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        edges = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
