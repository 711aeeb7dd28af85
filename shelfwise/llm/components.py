"""Connected components of a link table, by joins and grouped minima.

Every task first replaces its links by stars (a forest has fewer edges than any graph), then rounds of two star steps pull
all nodes towards the smallest id: neighbours larger than a node move to its smallest neighbour, then smaller ones do. The
number of rounds grows with the logarithm of the number of nodes, and no group of neighbours is ever gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.stage import stage

EDGES = "u bigint, v bigint"


def _stars(batches):
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [n for n in parent if root(n) != n]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(n) for n in part], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (first two columns) but those that are the smallest of their component."""
    edges = stage(links.toDF("u", "v").where("u IS NOT NULL AND v IS NOT NULL").mapInArrow(_stars, EDGES), "stars")
    while not _settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nearest = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(moved.union(nearest.select("u", F.col("m").alias("v"))).distinct(), "stars")
    return edges.toDF("node", "component")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    again = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    onward = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return again.union(onward).isEmpty()
