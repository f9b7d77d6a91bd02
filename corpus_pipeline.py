"""The corpus pipeline: five stages, each one operator of the llm subpackage over all that its predecessor kept.

quality       importance resampling; what the draw rejects goes
toxicity      weakly supervised scores; documents predicted toxic go
near_copies   n-gram Jaccard join; of each group of near copies the row of smallest id stays, once
secrets       base patterns and tagged spans are masked, n_chars follows the text
packing       what is left is packed into sequences; returns its pieces

Null and empty texts: they have no n-gram, weigh 0 in the draw and aren't toxic, are near no other, and hold the end token
alone. An empty table passes every stage and gives no pieces. Rows that repeat an id are judged by their own texts: a row
goes as a near copy only where its own text is one, and rows without an id come last in the choice. Very long texts are read
whole. Columns beyond those of documents, whatever their names, pass through the first four stages.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ngramjoin, packing, quality, secrets, toxicity
from quillspark.llm.shared import stage, unused
from quillspark.session import attach, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the draw keeps; each row is drawn by its own text."""
    attach(spark)
    name = unused(docs, "draw")
    return quality.drawn(docs, table(spark, sf_dir, "labels"), name=name).where(F.col(name)["kept"]).select(*columns(docs))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score of toxicity is below one half."""
    attach(spark)
    name = unused(docs, "toxicity")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).select(*columns(docs))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near copies connect: that of the smallest id, of equal ones the first written.

    Rows are numbered once, in storage, so that each is judged by its own text even where an id repeats."""
    attach(spark)
    row = unused(docs, "row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = ngramjoin.jaccard_components(numbered, key=row).where("n_shingles > 0").select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"))
    ids = numbered.select(F.col(row).alias("number"), F.col("doc_id").cast("long").alias("id"))
    members = found.join(ids, "number")
    # groups of one row need no choice
    crowds = stage(found.where("number <> `group`").select("group").distinct(), "crowds")
    crowded = members.join(crowds, "group")
    first = stage(crowded.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "number"))["number"].alias("chosen")), "chosen")
    gone = stage(crowded.join(first, "group").where("number <> chosen").select(F.col("number").alias(row)), "gone")
    return numbered.join(gone, row, "left_anti").select(*columns(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    attach(spark)
    made = secrets.redact(docs, secrets.fit(docs))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    attach(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_copies", keep_one_copy),
    ("secrets", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
