"""Streaming forms of batch queries over events(event_id, ts, user_id, event_type, value)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, temporary

LATE = "2 days"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed from their file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    made = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    made = events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    made = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """The first of each event id within the watermark, streaming or not."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return kept.select("event_id", "user_id", "event_type")


def run(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """A stream's result over all that its source has now, through Parquet in the shared folder; nothing passes the driver.

    In complete mode the last batch has the whole result; in append mode all batches together do. A repeated batch
    replaces itself."""
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    temporary(spark, path)
    numbers: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        numbers.append(number)
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    seen = sorted(set(numbers))
    return spark.read.schema(stream.schema).parquet(*(f"{path}/v={n}" for n in (seen[-1:] if mode == "complete" else seen)))


def each_batch(stream: DataFrame, path: str, checkpoint: str, keys: list[str], totals: list[str]):
    """Incremental totals by key: every batch is summed and merged into a table, batches counted once."""
    from ..sources.writers import upserted

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(*(F.sum(t).alias(t) for t in totals))
        # each batch writes its own version, so a repeated batch replaces itself
        before = f"{path}/v={number - 1}"
        if number:
            old = spark.read.parquet(before)
            both = old.unionByName(new).groupBy(*keys).agg(*(F.sum(t).alias(t) for t in totals))
            new = upserted(old, both, keys)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
