"""Readers of landed source files into records of papers, and checks of what was downloaded.

Services are read from files that a crawler has landed: the engine itself has no network.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .writers import download_status, union_sources

WORKS = "id STRING, display_name STRING, publication_year INT, publication_date STRING, doi STRING, type STRING, open_access STRUCT<is_oa: BOOLEAN>, abstract_inverted_index MAP<STRING, ARRAY<INT>>, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>"
SCHOLAR = "paperId STRING, title STRING, abstract STRING, year INT, venue STRING, isOpenAccess BOOLEAN, externalIds STRUCT<DOI: STRING, ArXiv: STRING>, authors ARRAY<STRUCT<name: STRING>>"
ATOM = "id STRING, title STRING, summary STRING, published STRING, author ARRAY<STRUCT<name: STRING>>"


def within(df: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Rows of years between two, both included, either open."""
    if first is not None:
        df = df.where(F.col("publication_year") >= first)
    return df if last is None else df.where(F.col("publication_year") <= last)


BROKEN = "quill_broken"


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that can't be read has its text in BROKEN."""
    read = F.from_json("value", f"{schema}, {BROKEN} STRING", {"columnNameOfCorruptRecord": BROKEN})
    return spark.read.text(path).where(F.trim("value") != "").select(read.alias("v")).select("v.*")


def works(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Open articles whose abstracts come as inverted indexes."""
    w = json_rows(spark, path, WORKS).where(f"{BROKEN} IS NULL AND type = 'article' AND open_access.is_oa")
    rows = w.select(
        F.substring_index("id", "/", -1).alias("paper_id"), F.col("display_name").alias("title"), text.inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), "publication_year", text.doi(F.col("doi")).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"),
        F.lit(None).cast("string").alias("venue"), "publication_date", F.lit("works").alias("source"))
    return within(rows, first, last)


def scholar(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    s = json_rows(spark, path, SCHOLAR).where(f"{BROKEN} IS NULL AND isOpenAccess")
    rows = s.select(
        F.concat(F.lit("ss_"), "paperId").alias("paper_id"), "title", "abstract", F.transform("authors", lambda a: a["name"]).alias("authors"), F.col("year").alias("publication_year"),
        text.doi(F.col("externalIds.DOI")).alias("doi"), text.arxiv_id(F.col("externalIds.ArXiv")).alias("arxiv_id"),
        "venue", F.lit(None).cast("string").alias("publication_date"), F.lit("scholar").alias("source"))
    return within(rows, first, last)


def atom(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Entries of an Atom feed; those without an identifier go."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    e = spark.read.format("xml").option("rowTag", "entry").option("columnNameOfCorruptRecord", BROKEN).schema(f"{ATOM}, {BROKEN} STRING").load(path).where(f"{BROKEN} IS NULL")
    rows = e.select(
        F.concat(F.lit("arxiv_"), text.arxiv_id(F.col("id"))).alias("paper_id"), squeezed(F.col("title")).alias("title"), squeezed(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: a["name"]).alias("authors"), F.substring("published", 1, 4).cast("int").alias("publication_year"), F.lit(None).cast("string").alias("doi"), text.arxiv_id(F.col("id")).alias("arxiv_id"),
        F.lit(None).cast("string").alias("venue"), F.col("published").alias("publication_date"), F.lit("atom").alias("source"))
    return within(rows.where("arxiv_id IS NOT NULL"), first, last)


def newest(rows: DataFrame, most: int) -> DataFrame:
    """The newest records of one source, at most so many, with place: their order by date (a year where there is none), then id."""
    order = [F.desc(F.coalesce("publication_date", F.col("publication_year").cast("string"))), "paper_id"]
    best = rows.orderBy(*order).limit(most)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(*order)))  # at most so many rows


def landed(spark: SparkSession, folder: str, most: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """Records of all sources under a folder (works, scholar, atom), the newest of each, with seq: the source's place, then the record's."""
    parts = [newest(read(spark, f"{folder}/{name}", first, last), most) for name, read in (("works", works), ("scholar", scholar), ("atom", atom))]
    return union_sources(parts).withColumn("seq", F.col("source_place") * 1_000_000 + F.col("place"))


def broken(spark: SparkSession, folder: str) -> DataFrame:
    """(source, line) of landed JSON that can't be read."""
    one = lambda name, schema: json_rows(spark, f"{folder}/{name}", schema).select(F.lit(name).alias("source"), F.col(BROKEN).alias("line"))
    return one("works", WORKS).unionByName(one("scholar", SCHOLAR)).where("line IS NOT NULL")


def downloads(spark: SparkSession, path: str, status: DataFrame | None = None) -> DataFrame:
    """(path, state) of files: what their status (200 if none is given) and first bytes say."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 8).cast("string").alias("head"))
    rows = files.withColumn("status", F.lit(200)) if status is None else files.join(status, "path")
    return rows.select("path", download_status(F.col("status"), F.col("head")).alias("state"))


def loaded(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A run's papers with full text; all of its papers where none has."""
    papers = spark.read.parquet(path).where(F.col("run_id") == run_id)
    full = papers.where("fulltext_resolved OR pdf_path IS NOT NULL")
    return full.unionByName(papers.join(full.select(F.lit(1).alias("quill_any")).limit(1), F.lit(True), "left_anti"))


def runs(manifests: DataFrame, k: int = 100) -> DataFrame:
    """The newest runs with their number of papers: the first of three counts that isn't 0, else 10."""
    n = F.coalesce(*(F.nullif(F.col(c), F.lit(0)) for c in ("valid_pdf_count", "selected_count", "papers")), F.lit(10))
    return manifests.select("run_id", "modified", n.alias("count")).orderBy(F.desc("modified"), "run_id").limit(k)
