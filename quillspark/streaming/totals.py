"""Totals by key that grow with a stream: every batch adds a small delta, and deltas are merged now and then."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE_EVERY = 8  # batches


def versions(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(kind, number) of what stands at a path: base or delta, and the last batch that it holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    done = [n for n in names if "=" in n and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return [(n.split("=")[0], int(n.split("=")[1])) for n in done]


def standing(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The folders that together hold every batch (up to one) once: the last base and the deltas behind it."""
    found = [(k, n) for k, n in versions(spark, path) if upto is None or n <= upto]
    base = max((n for k, n in found if k == "base"), default=-1)
    return [f"{path}/base={base}"] * (base >= 0) + [f"{path}/delta={n}" for k, n in sorted(found) if k == "delta" and n > base]


def added(rows: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(t).alias(t) for t in totals))


def accumulate(stream: DataFrame, path: str, checkpoint: str, keys: list[str], totals: list[str], merge_every: int = MERGE_EVERY):
    """A query that keeps sums of totals by keys at a path.

    A batch writes the sums of its own rows under its own number, so a repeated batch replaces itself, and work follows the batch,
    not the table. Every few batches the deltas become a new base, once, from folders that no longer change."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = added(batch, keys, totals)
        own.write.mode("overwrite").parquet(f"{path}/delta={number}")
        if number % merge_every == merge_every - 1 and ("base", number) not in versions(spark, path):
            whole = spark.read.schema(own.schema).parquet(*standing(spark, path, number))
            added(whole, keys, totals).write.mode("overwrite").parquet(f"{path}/base={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def current(spark: SparkSession, path: str, schema, keys: list[str], totals: list[str]) -> DataFrame:
    """The sums over all batches."""
    return added(spark.read.schema(schema).parquet(*standing(spark, path)), keys, totals)


def concentration(counts: DataFrame, period: str, n: str) -> DataFrame:
    """(period, hhi): the sum of squared shares of counts within a period, rounded to four places."""
    whole = counts.groupBy(period).agg(F.sum(n).alias("all"), F.sum(F.col(n).cast("double") * F.col(n)).alias("squares"))
    return whole.select(period, F.round(F.col("squares") / (F.col("all").cast("double") * F.col("all")), 4).alias("hhi"))
