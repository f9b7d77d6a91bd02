"""A content-addressed table of embeddings: what a model has made of a text is made once."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folders, published
from .ranking import words
from .columns import unit

ENTRY = "digest string, v array<double>"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(digest, v) of the cache; two writers may both have made an entry, which then is the same twice."""
    known = folders(spark, path)
    if not known:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(*known).dropDuplicates(["digest"])


def embedded(rows: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, int]:
    """(rows(id, text) with v, how many texts were embedded now).

    The address is a digest of the model's name and the text. Texts whose address the cache lacks are embedded once each by
    embed(digest, text) -> (digest, v) and published as a folder of their own, whole or not at all: readers never see a part,
    and a second writer of the same texts adds equal entries."""
    spark = rows.sparkSession
    address = F.sha2(F.concat_ws("\x1f", F.lit(model), F.coalesce("text", F.lit(""))), 256)
    asked = rows.withColumn("digest", address)
    missing = asked.join(entries(spark, path).select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    target = f"{path}/{uuid.uuid4().hex}"
    published(embed(missing.select("digest", F.coalesce("text", F.lit("")).alias("text"))).select("digest", F.col("v").cast("array<double>").alias("v")), target)
    made = spark.read.schema(ENTRY).parquet(target).count()
    return asked.join(entries(spark, path), "digest", "left").drop("digest"), made


def hashed_words(texts: DataFrame, size: int = 64) -> DataFrame:
    """(digest, v): the model that needs no network: signed counts of words by hash, of unit length; zeros for texts without words."""
    each = texts.select("digest", F.explode(words(F.col("text"))).alias("word"))
    place = F.pmod(F.xxhash64("word"), F.lit(size)).cast("int")
    sign = F.when(F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    parts = each.groupBy("digest", place.alias("place")).agg(F.sum(sign).alias("x")).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    zeros = F.array_repeat(F.lit(0.0), size)
    return texts.select("digest").join(parts.select("digest", whole.alias("v")), "digest", "left").select("digest", F.coalesce(unit(F.col("v")), zeros).alias("v"))
