"""Chains of any length (causes, replacements) by pointer doubling.

Each row points to one other at most (links: id, to). A round lets every unfinished pointer jump to where its target points, so that chains
of length n are followed in about log2(n) joins. Who has not reached an end after as many rounds as rows can need runs into a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.shared import checkpointed


def _pointers(links: DataFrame) -> DataFrame:
    """One pointer for each id, the least; ids that are only pointed to end their chains."""
    own = links.where("to is not null").groupBy("id").agg(F.min("to").alias("to"))
    ends = links.select("id").union(links.select("to")).where("id is not null").distinct().join(own.select("id"), "id", "left_anti")
    return own.select("id", "to", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")).union(
        ends.select("id", F.col("id").alias("to"), F.lit(0).cast("long"), F.lit(True)))


def chain_ends(links: DataFrame) -> DataFrame:
    """id, end, depth, in_cycle: the end of each id's chain and the steps to it; a chain that runs into a cycle has neither.

    An id that several links leave takes the least target; a link to itself is a cycle.
    """
    rows = checkpointed(_pointers(links))
    total, reach = rows.count(), 1
    while reach <= total and not rows.where("not done").isEmpty():
        ahead = rows.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("done").alias("over"))
        moved = rows.where("not done").join(ahead, "to").select("id", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("over").alias("done"))
        rows = checkpointed(rows.where("done").union(moved))
        reach *= 2
    return rows.select("id", F.when(F.col("done"), F.col("to")).alias("end"), F.when(F.col("done"), F.col("steps")).alias("depth"), (~F.col("done")).alias("in_cycle"))


def chain_paths(links: DataFrame, asked: DataFrame, most: int = 1 << 20) -> DataFrame:
    """id, ancestor, depth: all steps of the chains of the asked ids (id), each ancestor of a cycle once, up to ``most`` steps.

    With the pointers of 1, 2, 4, ... steps a path doubles in each round; what is returned grows with the paths themselves.
    """
    jump = checkpointed(_pointers(links).where("not done").select("id", "to"))
    paths = checkpointed(asked.select("id").distinct().select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("depth")))
    reach = 1
    while reach <= most:
        step = paths.join(jump.select(F.col("id").alias("ancestor"), F.col("to").alias("far")), "ancestor")
        new = step.select("id", F.col("far").alias("ancestor"), (F.col("depth") + reach).alias("depth"))
        fresh = checkpointed(new.groupBy("id", "ancestor").agg(F.min("depth").alias("depth")).join(paths.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            break
        paths = checkpointed(paths.union(fresh))
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("far"))
        jump = checkpointed(jump.join(far, "to").select("id", F.col("far").alias("to")))
        reach *= 2
    return paths.where(F.col("depth").between(1, most))
