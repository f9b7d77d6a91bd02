"""Linear reduction of vectors before clustering: the axes of greatest variance.

This stands in for the manifold projection that such pipelines use (a documented deviation):
few vectors or dimensions pass as they are, others keep as many axes as that projection would have.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import dot, unit

FEW, THIN = 6, 15  # fewer vectors, or no more dimensions, aren't reduced


def axes_wanted(n: int) -> int:
    return min(10, max(2, n // 4))


def moments(vectors: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n) of vectors(v) of d components.

    Every task sums its vectors' outer products and sends d + 1 rows of d + 1 sums, which are added by row: the driver gets
    (d + 1) x (d + 1) numbers, however many vectors there are."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    def added(part: pa.Table) -> pa.Table:
        sums = part["sums"].combine_chunks()
        whole = sums.flatten().to_numpy(zero_copy_only=False).reshape(len(sums), -1).sum(axis=0)
        return pa.table({"i": part["i"][:1], "sums": pa.array([whole], pa.list_(pa.float64()))})

    kind = "i long, sums array<double>"
    rows = vectors.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(partial, kind).groupBy("i").applyInArrow(added, kind).collect()  # d + 1 rows
    whole = np.array([r["sums"] for r in sorted(rows, key=lambda r: r["i"])]) if rows else np.zeros((d + 1, d + 1))
    n = int(round(whole[d, d]))
    mean = whole[d, :d] / max(n, 1)
    return mean, whole[:d, :d] / max(n, 1) - np.outer(mean, mean), n


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k axes as rows, the share of variance of each); an axis points to where its largest component is positive."""
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    chosen = axes[:, order].T
    chosen = chosen * np.where(chosen[np.arange(len(chosen)), np.abs(chosen).argmax(axis=1)] < 0, -1, 1)[:, None]
    return chosen, np.maximum(values[order], 0) / max(values.clip(0).sum(), 1e-300)


def reduced(vectors: DataFrame, n: int | None = None) -> DataFrame:
    """vectors(id, v) as unit vectors on their axes of greatest variance, or as they are where there is little to reduce.

    Vectors must have one length. Those of length 0 stay zeros."""
    n = vectors.count() if n is None else n
    first = vectors.select(F.size("v")).first()
    if first is None or n < FEW or first[0] <= THIN:
        return vectors
    d = first[0]
    rows = vectors.withColumn("v", F.coalesce(unit(F.col("v")), F.array_repeat(F.lit(0.0), d)))
    mean, covariance, _ = moments(rows, d)
    axes, _ = principal(covariance, min(axes_wanted(n), d))
    on = [dot(F.col("v"), F.array(*(F.lit(float(x)) for x in axis))) - F.lit(float(axis @ mean)) for axis in axes]
    return rows.withColumn("v", F.array(*on))
