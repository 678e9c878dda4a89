"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, discard


def components(links: DataFrame, by: str = "tbl", most_rounds: int | None = None) -> DataFrame:
    """``by, node, root``: the smallest node of the component of every node of ``links`` (by, a, b).

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones; after about the
    logarithm of the longest path all hang on their root. Rounds go on until nothing changes; one that would be the
    round after ``most_rounds``, if given, raises. Only two sums come to the driver in a round. Null ends and
    loops are left out; an empty table gives an empty result.
    """
    ends = links.select(by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges, before = cut_lineage(ends.distinct()), None
    rounds = 0
    while True:
        if rounds == most_rounds:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
        rounds += 1
        both = edges.unionByName(edges.select(by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(by, "u").agg(F.min("v").alias("m")).select(by, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, [by, "u"]).select(by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(by, "u").agg(F.min("v").alias("m"))
        rest = large.join(least, [by, "u"]).where("v <> m").select(by, F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, cut_lineage(rest.unionByName(least.select(by, "u", F.col("m").alias("v"))).distinct())
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(by, "u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(by, F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(by, F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
