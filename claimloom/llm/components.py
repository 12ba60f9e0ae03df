"""Connected components of an edge table: forests inside partitions, then alternating large and small stars.

First every partition replaces its edges by a spanning forest, each tree's nodes linked to its least node (union-find over
a bounded number of nodes at a time), so that chains and dense groups are mostly gone before anything is shuffled. Every
round then replaces a node's links by links to the least node it knows; after few rounds each node links to its
component's least node. Rounds are joins and aggregations over the edge table; it is cut through the shared checkpoint
folder after each, and only a row count and a sum of hashes reach the driver. Joins are sort-merge joins at every
size, so that many rounds leave no broadcast tables in the driver; hubs are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import checkpointed, forget

#: A node's own links are joined in this many parts, so that a hub is not one join key.
SALTS = 16
#: Nodes that a partition's union-find holds before its forest is put out.
FOREST = 200_000


def _with_least(links: DataFrame) -> DataFrame:
    """(x, y) links with least: the smallest of x and all its y."""
    least = links.groupBy("x").agg(F.min("y").alias("least"))
    least = least.select("x", F.least("x", "least").alias("least"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return links.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(SALTS)).cast("int")).join(least.hint("merge"), ["x", "salt"])


def _both(edges: DataFrame) -> DataFrame:
    flip = F.explode(
        F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
                F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
    )
    return edges.select(flip.alias("l")).select("l.x", "l.y")


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct edges u > v of (p, q) pairs."""
    return pairs.where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct()


def _forests(pairs: DataFrame) -> DataFrame:
    """(p, q) pairs with the components of the given ones: per partition a star for each tree of its spanning forest."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}

        def root(x):
            top = x
            while (up := least.get(top, top)) != top:
                top = up
            while (up := least.get(x, x)) != top:
                least[x] = top
                x = up
            return top

        def found() -> pa.RecordBatch:
            nodes = [x for x in least if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([least[x] for x in nodes], kind)], ["p", "q"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(p), root(q)
                least[max(a, b)] = least[min(a, b)] = min(a, b)
            if len(least) > FOREST:
                yield found()
                least.clear()
        if least:
            yield found()

    return pairs.mapInArrow(stars, pairs.schema)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes.

    ``component`` is the least node of the component. Nodes are of any ordered type but null.
    """
    edges = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).where("p <> q")
    edges = checkpointed(_edges(_forests(edges)))
    mark = None
    while True:
        large = _with_least(_both(edges)).where("y > x").select(F.col("y").alias("p"), F.col("least").alias("q"))
        down = _edges(large).select(F.col("u").alias("x"), F.col("v").alias("y"))
        small = _with_least(down)
        pairs = small.select(F.explode(F.array(
            F.struct(F.col("y").alias("p"), F.col("least").alias("q")),
            F.struct(F.col("x").alias("p"), F.col("least").alias("q")),
        )).alias("e")).select("e.p", "e.q")
        edges = checkpointed(_edges(pairs))
        forget(edges.sparkSession)
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )
