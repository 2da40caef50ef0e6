"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import store


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, m): the least node m of the component of every node u that isn't the least itself.

    edges: (u, v) of bigint, either way round. Each round joins every node to
    the least of its neighbours; it ends when every node has one edge, to a node
    that has none itself, or when a round changes nothing. Stars keep to one row for each edge, so a hub costs no more than its edges, and
    the joins split by size.
    """
    e = store.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    said = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes that have no smaller neighbour left keep an edge to the least by the larger ones above.
        large = large.distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = store.written(small, "edges")
        rows, nodes, *sums = e.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stars = rows == nodes and not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        if stars or (rows, nodes, *sums) == said:
            return e.select("u", F.col("v").alias("m"))
        said = (rows, nodes, *sums)
    raise RuntimeError(f"components have not settled in {rounds} rounds")
