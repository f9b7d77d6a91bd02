"""Connected components of a large edge table by repeated contraction.

Every round each vertex joins its neighbour (or itself) of the least priority, a
hash that changes with the round; edges are then renamed to the joined vertices
and those within one vertex go. The number of vertices that still have edges
falls geometrically, whatever order the ids came in. Parents of each round are
written to the shared folder and composed. Once LOCAL edges or fewer are left, one task on an
executor joins them by union-find: a bounded table, with the same result. Nothing
is collected to the driver but a count.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

LOCAL = 500_000


def joined_locally(live: DataFrame) -> DataFrame:
    """(id, parent) of the vertices of a bounded edge table, by union-find in one task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        ids = np.fromiter(parent, np.int64, len(parent))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([root(int(i)) for i in ids], pa.int64())], ["id", "parent"])

    return live.select("a", "b").repartition(1).mapInArrow(kernel, "id long, parent long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of edges (a, b): component is the smallest id that links reach."""
    live = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    parents: list[DataFrame] = []
    for seed in range(rounds):
        if not (edges_left := live.count()):
            break
        if edges_left <= LOCAL:
            parents.append(stage(joined_locally(live), "parents"))
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        least = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("to"))
        joined = stage(least.select(F.col("a").alias("id"), F.least(F.col("m"), own)["to"].alias("parent")), "parents")
        parents.append(joined)
        left = joined.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        right = joined.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        moved = live.join(left, "a").join(right, "b").where("pa <> pb")
        live = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    if not parents:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)

    def follow(found: DataFrame, more: DataFrame) -> DataFrame:
        step = more.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        return found.join(step, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"))

    found = reduce(follow, parents)
    # written first, so that the join has plain exchanges and a crowded component is split
    least = stage(found.groupBy("parent").agg(F.min("id").alias("component")), "least")
    return found.join(least, "parent").select("id", "component")
