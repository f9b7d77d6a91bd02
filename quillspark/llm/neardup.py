"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact verification, components.

Equal vectors of one label are one class with a weight. A class's signs against
the hyperplanes of a table are its bucket there; with the bits b and tables T
below, a pair at the threshold meets in some table with probability RECALL at
least, closer pairs more often. Buckets are compared by exact cosine in double
precision, and a pair counts in the first table where it meets, so links are
counted and never listed. A bucket of more than CHUNK classes is dealt as a grid
of chunk pairs to many tasks; nothing is capped. Each cell gives every class its
number of links and one edge of a spanning forest to the component search.

Defined results: vectors that are null, zero or hold null or non-finite
components, and those of a null label, link with nothing and are their own
component. Vectors of unequal length never link. Rows that repeat an id count as
vectors of their own, each with the links of its own vector. Ties cannot occur; other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach, table
from .components import components
from .shared import scratch, stage
from .topk import sound

THRESHOLD, RECALL = 0.93, 0.97
CHUNK, SEED = 1024, 20_240_607
BITS = (4, 18)


def shape(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for the largest label's number of classes: about 64 classes a bucket, if they spread."""
    bits = min(max(BITS[0], math.ceil(math.log2(max(largest, 1) / 64 + 1))), BITS[1])
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def signs(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row in each table."""
    planes = np.random.default_rng((SEED, vectors.shape[1])).standard_normal((vectors.shape[1], tables * bits))
    above = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return above @ (1 << np.arange(bits, dtype=np.int64))


def hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for each class and table: t, bucket, label, dim, class."""
    out = "t int, bucket long, label string, dim int, class long"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, vectors in by_length(b, 2):
                found = signs(vectors, bits, tables)
                n = part.num_rows
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, t, np.int32)), pa.array(found[:, t]), part.column(0), pa.array(np.full(n, dim, np.int32)), part.column(1),
                    ], ["t", "bucket", "label", "dim", "class"])

    return classes.select("label", "class", "vector").mapInArrow(kernel, out)


def by_length(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, unit vectors in double precision) for each length of a batch's vectors."""
    sizes = b.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        part = b.take(pa.array(np.flatnonzero(sizes == dim)))
        vectors = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
        yield int(dim), part, vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def compared(side: pa.Table, threshold: float, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one cell: classes, links counted here, and each class's root among the cell's links."""
    names, weight = side["class"].to_numpy(), side["weight"].to_numpy()
    chunk, t = side["chunk"].to_numpy(), side["t"][0].as_py()
    vectors = next(by_length(side.select(["vector"]).combine_chunks().to_batches()[0], 0))[2]
    linked = vectors @ vectors.T >= threshold
    np.fill_diagonal(linked, False)
    if side["lo"][0].as_py() != side["hi"][0].as_py():
        linked &= chunk[:, None] != chunk[None, :]
    new = linked.copy()
    if t and linked.any():  # pairs that met in a table before were counted there
        buckets = signs(vectors, bits, tables)
        a, b = np.nonzero(linked)
        new[a, b] = (buckets[a, :t] != buckets[b, :t]).all(axis=1)
    root = np.arange(len(names))
    while True:
        least = np.where(linked, root[None, :], len(names)).min(axis=1, initial=len(names))
        lower = np.minimum(root, least)
        if (lower == root).all():
            break
        root = lower
    return names, new @ weight, names[root]


def cells(dealt: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """(class, links, root) from rows dealt and sorted by cell; a cell may go on in the next batch."""
    key = ["t", "label", "dim", "bucket", "lo", "hi"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held and sum(x.num_rows for x in held) > 1:
                named, links, roots = compared(pa.concat_tables(held), threshold, bits, tables)
                if links.any() or (named != roots).any():
                    yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(links), pa.array(roots)], ["class", "links", "root"])

        last = None
        for b in batches:
            names = list(zip(*(b.column(k).to_pylist() for k in key)))
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
            whole = pa.Table.from_batches([b])
            for a, z in zip(starts, starts[1:]):
                if names[a] != last:
                    yield from flush()
                    held, last = [], names[a]
                held.append(whole.slice(a, z - a))
        yield from flush()

    return dealt.mapInArrow(kernel, "class long, links long, root long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of df."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"), F.xxhash64(F.col(vector)).alias("digest"))
    squares = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & sound(F.col("vector")) & (F.coalesce(squares, F.lit(0.0)) > 0)
    alike = rows.where(usable).groupBy("label", "digest", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = stage(alike.withColumn("class", F.monotonically_increasing_id()), "classes")
    with scratch() as keep:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        bits, tables = shape(largest, threshold)
        place = ["t", "label", "dim", "bucket"]
        made = stage(hashed(classes, bits, tables), "buckets")
        # buckets are counted and dealt without their vectors, which join each cell once
        split = stage(made.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*place, F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "split")
        chunks = made.join(split, place).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("parts").cast("long")).cast("int"))
        other = chunks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = other.select(*place, F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "class")
        dealt = dealt.join(classes.select("class", "weight", "vector"), "class")
        cell = [*place, "lo", "hi"]
        found = stage(cells(dealt.repartition(*cell).sortWithinPartitions(*cell), threshold, bits, tables), "cells")
        links = found.groupBy("class").agg(F.sum("links").alias("links"))
        joined = components(found.where("`class` <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
        grouped = stage(classes.join(joined.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")), "grouped")
        least = stage(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        facts = keep(grouped.join(least, "component").join(links, "class", "left").select(
            F.col("label").alias("l"), F.col("digest").alias("d"), F.col("vector").alias("v"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id"), "facts")
    on = (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")) & (F.col("vector") == F.col("v"))
    component = F.coalesce("component_id", "vec_id")
    return rows.join(facts, on, "left").select(
        "vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, compared within their label."""
    attach(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_neardup": op9_neardup}
ORACLE_SQL: dict[str, str] = {}
