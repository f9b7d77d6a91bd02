"""Connected components of an edge table of any size, and an order to decide records in.

Each round every vertex that still has edges joins its neighbour (or itself) of the least
priority, a hash that changes with the round; edges then lead between what was joined, and those inside
one go. Their number falls geometrically whatever the ids, a chain included. Once LOCAL edges
are left one task ends it. Nothing is collected but counts.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

LOCAL = 500_000


def joined(live: DataFrame) -> DataFrame:
    """(seq, to) for the vertices of a bounded edge table (a, b)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], ["seq", "to"])

    return live.select("a", "b").repartition(1).mapInArrow(kernel, "seq long, to long")


def groups(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(seq, group): the smallest number that edges (canonical, duplicate) reach, for every vertex of an edge."""
    ends = edges.select(F.col("canonical").cast("long").alias("x"), F.col("duplicate").cast("long").alias("y")).where("x <> y")
    live = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    known: DataFrame | None = None
    turn = 0
    while (count := live.count()) or known is None:
        if count <= local:
            step, live = written(joined(live), "joined"), live.limit(0)
        else:
            rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: E731, B023
            both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("to"))).alias("m"))
            own = F.struct(rank(F.col("a")).alias("r"), F.col("a").alias("to"))
            step = written(near.select(F.col("a").alias("seq"), F.least("m", own)["to"].alias("to")), "joined")
            for c in ("a", "b"):
                live = live.join(step.select(F.col("seq").alias(c), F.col("to").alias(f"to_{c}")), c)
            live = written(live.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        after = step.select(F.col("seq").alias("to"), F.col("to").alias("next"))
        known = step if known is None else written(known.join(after, "to", "left").select("seq", F.coalesce("next", "to").alias("to")), "known")
        turn += 1
    # written first, so that a crowded group's join can be split
    least = written(known.groupBy("to").agg(F.min("seq").alias("group")), "least")
    return known.join(least, "to").select("seq", "group")
