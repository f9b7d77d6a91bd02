"""What a dashboard asks of stored results."""
from __future__ import annotations

import colorsys
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent


def mention_frequency(mentions: DataFrame, papers: DataFrame, k: int = 20) -> DataFrame:
    """(name, mentions, share): the k names with most mentions, repeats within a paper counted, to one place of all papers."""
    total = F.broadcast(papers.agg(F.count(F.lit(1)).alias("total")))
    counts = mentions.groupBy("name").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "name").limit(k)
    return counts.join(total).select("name", "mentions", F.round(percent(F.col("mentions"), F.col("total")), 1).alias("share"))


def bars(frequencies: DataFrame, k: int = 5) -> DataFrame:
    return frequencies.orderBy(F.desc("mentions"), "name").limit(k).select("name", F.bround("share").cast("long").alias("share"))


def fallback_gaps(limitations: DataFrame, k: int = 5) -> DataFrame:
    """The first limitations of more than ten letters."""
    return limitations.where(F.length("text") > 10).orderBy("paper_id", "seq").limit(k)


def filter_links(links: DataFrame, relation: str = "", theme: str = "", words: str = "") -> DataFrame:
    if relation:
        links = links.where(F.col("relation") == relation)
    if theme:
        links = links.where(F.col("theme_id") == theme)
    if words:
        found = [F.contains(F.lower(F.col(c).cast("string")), F.lit(words.lower())) for c in ("source", "target", "theme_id")]
        links = links.where(found[0] | found[1] | found[2])
    return links


def status_counts(themes: DataFrame) -> DataFrame:
    return themes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def provenance_of(papers: DataFrame, key: str) -> DataFrame:
    """A paper by id or title; nothing where there is none."""
    return papers.where((F.col("paper_id") == key) | (F.lower("title") == key.lower()))


def hue(place: Column, n: Column) -> Column:
    """The colour of one of n clusters, evenly spaced."""

    @F.pandas_udf("string")
    def colour(i: pd.Series, of: pd.Series) -> pd.Series:
        parts = [colorsys.hls_to_rgb((a / max(1, b) + 0.60) % 1, 0.46, 0.85) for a, b in zip(i, of)]
        return pd.Series(["#" + "".join(f"{int(c * 255):02x}" for c in p) for p in parts])

    return colour(place, n)


def analysis(run_id: str, title: str, papers: DataFrame, methods: DataFrame, datasets: DataFrame, clusters: DataFrame, themes: DataFrame, links: DataFrame, limitations: DataFrame, k: int = 20) -> DataFrame:
    """One row with all that a dashboard shows of a run: counts, concentration, the k most used methods and datasets, areas
    with their percentages, themes, and the evidence statistics. Every list is cut or bounded by clusters and themes.

    papers(paper_id, year), methods and datasets(paper_id, name), clusters(cluster_id, n), themes(theme_id, papers, status),
    links and limitations with a row for each."""
    from .gaps import donut, summary
    from .trends import adoption, concentration, usage

    def top(rows: DataFrame, name: str) -> DataFrame:
        best = adoption(rows, papers).orderBy(F.desc("papers"), "name").limit(k)
        listed = F.array_sort(F.collect_list(F.struct((-F.col("papers")).alias("o"), "name", "papers", F.round("share", 2).alias("share"))))
        return best.agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["papers"].alias("papers"), x["share"].alias("share"))).alias(name))

    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    hhi = concentration(usage(datasets)).select("hhi", F.col("label").alias("hhi_label"))
    areas = donut(clusters).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "n", "percent"))).alias("areas"), F.count(F.lit(1)).alias("areas_count"))
    shown = themes.agg(F.array_sort(F.collect_list(F.struct("theme_id", "papers", "status"))).alias("gaps"))
    span = papers.agg(F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string")).alias("year_range"))
    parts = [
        count(papers, "paper_count"), span, methods.agg(F.countDistinct("name").alias("methods_count")), datasets.agg(F.countDistinct("name").alias("benchmarks_count")),
        hhi, top(methods, "top_methods"), top(datasets, "top_benchmarks"), areas, shown, count(links, "total_links"),
        summary(themes, limitations).select(F.col("open").alias("open_gaps"), F.col("resolved").alias("resolved_gaps"), F.col("themes").alias("total_themes"), F.col("limitations").alias("total_limitations")),
    ]
    one = papers.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(title).alias("title"))
    for part in parts:  # single rows
        one = one.join(part)
    return one


def duplicate_labels(labels: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(a, b, ratio) of clusters whose labels match; a row for each pair of clusters, which are few."""

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p.lower().strip(), q.lower().strip()).ratio() for p, q in zip(x, y)], dtype="float64")

    left, right = (labels.select(F.col("cluster_id").alias(k), F.col("label").alias(f"l{k}")) for k in "ab")
    return left.join(right, F.col("a") < F.col("b")).withColumn("ratio", similar("la", "lb")).where(F.col("ratio") >= ratio).select("a", "b", "ratio")


def round_limits(target: Column) -> Column:
    """struct(enough, per_source): when a search round stops, and how much a source is asked for."""
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x.cast("int")))
    return F.struct(clamp(target * 1.5, 10, 200).alias("enough"), clamp(target * 1.2, 10, 100).alias("per_source"))
