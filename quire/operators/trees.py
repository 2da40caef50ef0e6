"""Trees as tables of nodes with the id of their parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
MAX_DEPTH = 64


def paths(nodes: DataFrame, tasks: int) -> DataFrame:
    """(id, depth, path) of nodes (id, parent, role) that hang on a root, level by level; cycles are never reached.

    A level is joined to the nodes below it by a merge join over nodes that are
    dealt by parent and sorted once, and is kept on the executors: nothing is
    broadcast, so the driver holds no rows however many nodes there are.
    """
    below = nodes.where("parent is not null").repartition(tasks, "parent").sortWithinPartitions("parent").localCheckpoint()
    level = nodes.where("parent is null").select("id", F.lit(0).alias("depth"), F.col("role").alias("path")).localCheckpoint()
    out = level
    for depth in range(1, MAX_DEPTH + 1):
        above = level.select(F.col("id").alias("above"), F.col("path").alias("before"))
        level = below.hint("merge").join(above, F.col("parent") == F.col("above")).select("id", F.lit(depth).alias("depth"), F.concat("before", F.lit("/"), "role").alias("path")).localCheckpoint()
        if level.isEmpty():
            break
        out = out.unionAll(level)
    return out
