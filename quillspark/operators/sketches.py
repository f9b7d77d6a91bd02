"""Aggregates that merge, approximate or exact: how many papers a thing has, and how many two things or two years share, without rereading papers.

Sketches are rows of a table, one for each year and name; any of them can be united later."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 12  # a sketch keeps 2^SIZE hashes: a standard error of about 1.6 % once it is full, none before


def paper_sketches(mentions: DataFrame, size: int = SIZE) -> DataFrame:
    """(year, name, papers) of mentions(paper_id, year, name): sketches of the papers that name a thing in a year."""
    return mentions.groupBy("year", "name").agg(F.theta_sketch_agg(F.col("paper_id"), size).alias("papers"))


def overlaps(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """(year, next_year, papers, next_papers, shared): per two years that follow each other, the estimated numbers of names' users."""
    years = sketches.groupBy("year").agg(F.theta_union_agg("papers", size).alias("papers"))
    after = years.select((F.col("year") - 1).alias("year"), F.col("papers").alias("next"))
    count = F.theta_sketch_estimate
    return years.join(after, "year").select(
        "year", (F.col("year") + 1).alias("next_year"), count("papers").alias("papers"), count("next").alias("next_papers"), count(F.theta_intersection("papers", "next")).alias("shared"))


def paper_bitmaps(mentions: DataFrame) -> DataFrame:
    """(year, name, bucket, papers) of mentions(paper_id, year, name): the papers that name a thing in a year as bits, 32,768 whole
    numbers to a bucket. They unite as sketches do, and exactly; numbers that lie far apart are better kept as sketches."""
    each = mentions.where("paper_id IS NOT NULL").select("year", "name", "paper_id").distinct()
    return each.groupBy("year", "name", F.bitmap_bucket_number("paper_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("paper_id")).alias("papers"))


def exact_overlaps(bitmaps: DataFrame) -> DataFrame:
    """overlaps by counting: a row for each two years that follow each other and have a paper."""
    years = bitmaps.groupBy("year", "bucket").agg(F.bitmap_or_agg("papers").alias("papers"))
    sizes = years.groupBy("year").agg(F.sum(F.bitmap_count("papers")).alias("papers"))
    both = years.unionByName(years.withColumn("year", F.col("year") - 1).withColumn("next", F.lit(True)), allowMissingColumns=True)
    met = both.groupBy("year", "bucket").agg(F.bitmap_and_agg("papers").alias("papers"), F.count(F.lit(1)).alias("n")).where("n = 2")
    shared = met.groupBy("year").agg(F.sum(F.bitmap_count("papers")).alias("shared"))
    after = sizes.select((F.col("year") - 1).alias("year"), F.col("papers").alias("next_papers"))
    made = sizes.join(after, "year").join(shared, "year", "left")
    return made.select("year", (F.col("year") + 1).alias("next_year"), "papers", "next_papers", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


def value_sketches(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): quantile sketches."""
    return rows.groupBy(key).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"))


def quantiles(sketches: DataFrame, at: list[float]) -> DataFrame:
    """(q, value) over all sketches together."""
    whole = sketches.agg(F.kll_merge_agg_double("values").alias("values"))
    each = F.array(*(F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("values", F.lit(q)).alias("value")) for q in at))
    return whole.select(F.explode(each).alias("e")).select("e.*")
