"""Adoption of entities over time, and how concentrated their use is.

Inputs: mentions(paper_id, year, seq, name, role) with seq any orderable column that
gives the order of mentions within a paper; papers(paper_id, year) for the
denominators, papers without mentions included. Every operator is a plan of
aggregates; only tables bounded by the number of years are broadcast.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import growth_rate, percent

DEFAULT_YEAR = 2026
DOMINANT_SHARE, SNAPSHOT_SHARE, DOMINANT_LATE, GROWTH = 30.0, 25.0, 0.25, 25.0
HIGH, MODERATE = 0.25, 0.15


def yearly_totals(papers: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """(year, papers): the denominator of each year; a missing year counts as the default one."""
    year = F.coalesce(F.nullif(F.col("year"), F.lit(0)), F.lit(default_year)).cast("int")
    return papers.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("papers"))


def first_mentions(mentions: DataFrame) -> DataFrame:
    """(paper_id, year, name, seq, role): the first mention of each name in each paper."""
    first = F.min(F.struct("seq", "role")).alias("first")
    return mentions.groupBy("paper_id", "year", "name").agg(first).select("paper_id", "year", "name", "first.seq", "first.role")


def primary_role(mentions: DataFrame) -> DataFrame:
    """(name, role, papers): the most frequent role of first mentions; of equals the one met first."""
    counts = first_mentions(mentions).groupBy("name", "role").agg(F.count(F.lit(1)).alias("papers"), F.min(F.struct("paper_id", "seq")).alias("at"))
    order = Window.partitionBy("name").orderBy(F.desc("papers"), "at", "role")
    return counts.withColumn("n", F.row_number().over(order)).where("n = 1").select("name", "role", "papers")


def adoption(mentions: DataFrame, papers: DataFrame) -> DataFrame:
    """(name, papers, share): distinct papers of each name and their percentage of all papers."""
    total = F.broadcast(papers.agg(F.count(F.lit(1)).alias("total")))
    used = mentions.groupBy("name").agg(F.countDistinct("paper_id").alias("papers"))
    return used.join(total).select("name", "papers", percent(F.col("papers"), F.col("total")).alias("share"))


def yearly_distribution(mentions: DataFrame, papers: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """(name, year, papers, share, total): every name in every year of the corpus, zeros included."""
    totals = F.broadcast(yearly_totals(papers, default_year).withColumnRenamed("papers", "total"))
    year = F.coalesce(F.nullif(F.col("year"), F.lit(0)), F.lit(default_year)).cast("int")
    used = mentions.select("name", year.alias("year"), "paper_id").groupBy("name", "year").agg(F.countDistinct("paper_id").alias("papers"))
    dense = used.select("name").distinct().join(totals)  # names x years of the corpus
    whole = dense.join(used, ["name", "year"], "left")
    n = F.coalesce("papers", F.lit(0).cast("long"))
    return whole.select("name", "year", n.alias("papers"), percent(n, F.col("total")).alias("share"), "total")


def growth(mentions: DataFrame, papers: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """(name, early, late, growth): mean yearly proportions of the first and second half of the years present."""
    years = yearly_totals(papers, default_year).select("year")
    order = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = years.select("year", F.count(F.lit(1)).over(order).alias("place"), F.count(F.lit(1)).over(every).alias("years"))  # a row for each year
    half = F.greatest(F.lit(1), F.floor(F.col("years") / 2))
    rows = yearly_distribution(mentions, papers, default_year).join(F.broadcast(ranked), "year")
    p = F.col("papers") / F.col("total")
    mean = lambda side: F.coalesce(F.avg(F.when(side, p)), F.lit(0.0))
    made = rows.groupBy("name").agg(mean(F.col("place") <= half).alias("early"), mean(F.col("place") > half).alias("late"), F.max("years").alias("years"))
    return made.withColumn("growth", growth_rate(F.col("early"), F.col("late")))


def trajectory(mentions: DataFrame, papers: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """name, papers, share, role, early, late, growth, trajectory, confidence of every name."""
    facts = adoption(mentions, papers).join(primary_role(mentions).select("name", "role"), "name").join(growth(mentions, papers, default_year), "name")
    compared = F.col("role").isin("baseline", "compared")
    snapshot = F.when(compared, F.lit("BASELINE_COMPARATOR")).when(F.col("share") >= SNAPSHOT_SHARE, "DOMINANT").when(F.col("papers") >= 2, "STABLE").otherwise("SPECIALIZED")
    longer = (
        F.when((F.col("share") >= DOMINANT_SHARE) & (F.col("late") >= DOMINANT_LATE), "DOMINANT")
        .when((F.col("early") == 0) & (F.col("late") > 0) & (F.col("role") == "proposed"), "EMERGING")
        .when(F.col("growth") > GROWTH, "INCREASING").when(F.col("growth") < -GROWTH, "DECLINING").otherwise("STABLE")
    )
    short = F.col("years") <= 1
    named = facts.withColumn("trajectory", F.when(short, snapshot).otherwise(longer))
    sure = {"BASELINE_COMPARATOR": (0.95, 0.95), "DOMINANT": (0.90, 0.95), "EMERGING": (0.92, 0.92), "INCREASING": (0.90, 0.90), "DECLINING": (0.88, 0.88), "STABLE": (0.85, 0.85), "SPECIALIZED": (0.80, 0.80)}
    value = F.coalesce(*(F.when(F.col("trajectory") == k, F.when(short, a).otherwise(b)) for k, (a, b) in sure.items()))
    return named.withColumn("confidence", value).drop("years")


def emerging(mentions: DataFrame, papers: DataFrame, k: int = 20) -> DataFrame:
    """The k entities of emerging or increasing use with most papers."""
    found = trajectory(mentions, papers).where(F.col("trajectory").isin("EMERGING", "INCREASING"))
    return found.orderBy(F.desc("papers"), "name").limit(k)


def corpus_mode(papers: DataFrame) -> DataFrame:
    """(first_year, last_year, mode)."""
    span = papers.where("year IS NOT NULL").agg(F.coalesce(F.min("year"), F.lit(DEFAULT_YEAR)).alias("first_year"), F.coalesce(F.max("year"), F.lit(DEFAULT_YEAR)).alias("last_year"))
    return span.withColumn("mode", F.when(F.col("last_year") - F.col("first_year") <= 1, "SNAPSHOT").otherwise("LONGITUDINAL"))


def usage(mentions: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """(paper_id, name): each use once, names that contain an excluded word left out."""
    kept = mentions.select("paper_id", "name").distinct()
    for word in excluded:
        kept = kept.where(~F.lower("name").contains(word))
    return kept


def concentration_label(hhi):
    return (
        F.when(hhi >= HIGH, "Highly Concentrated Benchmarks").when(hhi >= MODERATE, "Moderately Concentrated Benchmarks")
        .otherwise("Well-Diversified Benchmarks")
    )


def concentration(uses: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., uses, names, hhi, label): Herfindahl-Hirschman index over uses, four places."""
    counts = uses.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"))
    made = counts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uses"), F.count(F.lit(1)).alias("names"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    hhi = F.round(F.when(F.col("uses") > 0, F.col("squares") / (F.col("uses").cast("double") * F.col("uses"))).otherwise(0.0), 4)
    made = made.withColumn("hhi", hhi)
    return made.select(*by, "uses", "names", "hhi", F.when(F.col("uses") == 0, "Well-Diversified").otherwise(concentration_label(F.col("hhi"))).alias("label"))


def concentration_shares(uses: DataFrame, papers: DataFrame) -> DataFrame:
    """top1, top3 and synthetic shares of uses; single- and multi-dataset shares of all papers."""
    counts = uses.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    synthetic = F.lower("name").rlike("synth|simulat")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uses"), F.coalesce(F.sum(F.when(synthetic, F.col("n"))), F.lit(0)).alias("synthetic"))
    top = counts.orderBy(F.desc("n"), "name").limit(3).agg(F.coalesce(F.max("n"), F.lit(0)).alias("top1"), F.coalesce(F.sum("n"), F.lit(0)).alias("top3"))
    each = uses.groupBy("paper_id").agg(F.count(F.lit(1)).alias("k"))
    split = each.agg(F.count(F.when(F.col("k") == 1, 1)).alias("single"), F.count(F.when(F.col("k") > 1, 1)).alias("multi"))
    total = papers.agg(F.count(F.lit(1)).alias("total"))
    one = sums.join(top).join(split).join(total)  # four single rows
    part = lambda a, b, c: percent(F.col(a), F.col(b)).alias(c)
    return one.select(part("top1", "uses", "top1_share"), part("top3", "uses", "top3_share"), part("synthetic", "uses", "synthetic_share"), part("single", "total", "single_share"), part("multi", "total", "multi_share"))


def monopolies(uses: DataFrame, papers: DataFrame, share: float = SNAPSHOT_SHARE) -> DataFrame:
    """(name, papers, share, monopoly): whether a dataset is used by so large a share of papers."""
    return adoption(uses, papers).withColumn("monopoly", F.col("share") >= share)


def first_papers(firsts: DataFrame, k: int = 10) -> DataFrame:
    """(name, top_papers): the first k papers of each name, ranked before they are gathered."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("paper_id"))
    best = firsts.select("name", "paper_id").distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return best.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x["paper_id"]).alias("top_papers"))


def method_profiles(mentions: DataFrame, papers: DataFrame) -> DataFrame:
    """(name, family, kind, role, aliases, papers, share, top_papers) of each name: mentions also hold alias, family and kind.

    Spellings count from first mentions alone; family and kind are those of the last paper, share has two places."""
    first = F.min(F.struct("seq", "role", "alias", "family", "kind")).alias("first")
    firsts = mentions.groupBy("paper_id", "name").agg(first).select("paper_id", "name", "first.*")
    facts = firsts.groupBy("name").agg(
        F.max(F.struct("paper_id", "family", "kind")).alias("last"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.count(F.lit(1)).alias("papers"))
    total = F.broadcast(papers.agg(F.count(F.lit(1)).alias("total")))
    roles = primary_role(mentions).select("name", "role")
    made = facts.join(total).join(roles, "name").join(first_papers(firsts), "name")
    return made.select("name", "last.family", "last.kind", "role", "aliases", "papers", F.round(percent(F.col("papers"), F.col("total")), 2).alias("share"), "top_papers")


def dataset_profiles(mentions: DataFrame, papers: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """(name, modality, aliases, papers, share, monopoly, synthetic, top_papers): spellings that contain an excluded word
    don't count; a dataset is synthetic if the first mention in some paper says so."""
    for word in excluded:
        mentions = mentions.where(~F.lower("alias").contains(word))
    firsts = mentions.groupBy("paper_id", "name").agg(F.min(F.struct("seq", "alias", "family")).alias("first")).select("paper_id", "name", "first.*")
    facts = firsts.groupBy("name").agg(F.max(F.struct("paper_id", "family"))["family"].alias("modality"), F.max(F.lower("alias").rlike("synth|simulat")).alias("synthetic"), F.count(F.lit(1)).alias("papers"))
    aliases = mentions.groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    total = F.broadcast(papers.agg(F.count(F.lit(1)).alias("total")))
    share = F.round(percent(F.col("papers"), F.col("total")), 2)
    made = facts.join(total).join(aliases, "name").join(first_papers(firsts), "name")
    return made.select("name", "modality", "aliases", "papers", share.alias("share"), (share >= SNAPSHOT_SHARE).alias("monopoly"), "synthetic", "top_papers")


def cluster_profiles(members: DataFrame, mentions: DataFrame, limitations: DataFrame, most: int = 4) -> DataFrame:
    """(cluster_id, papers, family, kind, limitations): the family and kind that most names of a cluster's papers have, a
    name counting once a paper, and its first distinct limitations of more than ten letters, cut to 120."""
    each = mentions.groupBy("paper_id", "name").agg(F.min(F.struct("seq", "family", "kind")).alias("first")).select("paper_id", "name", "first.family", "first.kind")
    used = members.join(each, "paper_id")

    def leading(column: str, rest: str) -> DataFrame:
        counts = used.groupBy("cluster_id", column).agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))["v"].alias(column))
        return members.select("cluster_id").distinct().join(best, "cluster_id", "left").select("cluster_id", F.coalesce(column, F.lit(rest)).alias(column))

    said = members.join(limitations.where(F.length("text") > 10).select("paper_id", F.substring("text", 1, 120).alias("text")), "paper_id").select("cluster_id", "text").distinct()
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("text"))
    said = said.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("cluster_id").agg(F.array_sort(F.collect_list("text")).alias("limitations"))
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("papers"))
    made = size.join(leading("family", "Specialized Methodologies"), "cluster_id").join(leading("kind", "Adaptive Scientific AI"), "cluster_id").join(said, "cluster_id", "left")
    return made.select("cluster_id", "papers", "family", "kind", F.coalesce("limitations", F.array().cast("array<string>")).alias("limitations"))


def cluster_affinity(members: DataFrame, mentions: DataFrame, k: int = 5) -> DataFrame:
    """(cluster_id, rank, name, papers, share): the k names that most papers of a cluster use, of its whole size."""
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    used = members.join(mentions.select("paper_id", "name").distinct(), "paper_id").groupBy("cluster_id", "name").agg(F.count(F.lit(1)).alias("papers"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("papers"), "name")
    best = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(F.broadcast(size), "cluster_id").select("cluster_id", "rank", "name", "papers", percent(F.col("papers"), F.col("size")).alias("share"))


def ontology_rollup(entities: DataFrame) -> DataFrame:
    """(paradigm, family, canonical, aliases, papers) at all three levels: entities(paradigm, family, canonical, alias, paper_id)."""
    made = entities.rollup("paradigm", "family", "canonical").agg(F.countDistinct("alias").alias("aliases"), F.countDistinct("paper_id").alias("papers"))
    return made.where("paradigm IS NOT NULL")


def cross_paper_gaps(limitations: DataFrame, future: DataFrame, papers: DataFrame, synthetic_share: float) -> DataFrame:
    """(gap_id, kind, papers, confidence, quotes): the four templates, numbered as far as they are met.

    limitations and future: (paper_id, seq, category, text)."""
    def of(df: DataFrame, kinds: list[str]) -> DataFrame:
        return df.where(F.col("category").isin(kinds))

    total = papers.count()
    least = 1 if total <= 3 else 2
    templates = [
        (1, "validation", ["generalization", "data_scarcity"], ["external_validation", "clinical_trial"], 0.94, least),
        (2, "cost", ["computational_cost", "scalability"], [], 0.91, least),
        (4, "safety", ["interpretability", "safety"], [], 0.92, 1),
    ]
    made = None
    for place, kind, lims, fw, sure, need in templates:
        rows = of(limitations, lims).select("paper_id", "seq", "text", F.lit(0).alias("side"))
        if fw:
            rows = rows.unionByName(of(future, fw).select("paper_id", "seq", "text", F.lit(1).alias("side")))
        order = Window.partitionBy("side").orderBy("paper_id", "seq")
        quotes = rows.withColumn("n", F.row_number().over(order)).where("n <= 3")
        quoted = quotes.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("side", "n", "text"))), lambda x: x["text"]), 1, 4).alias("quotes"))
        found = rows.agg(F.countDistinct("paper_id").alias("papers")).join(quoted)
        found = found.where(F.col("papers") >= need).select(F.lit(place).alias("place"), F.lit(kind).alias("kind"), "papers", F.lit(sure).alias("confidence"), "quotes")
        made = found if made is None else made.unionByName(found)
    if synthetic_share >= 20:
        one = papers.sparkSession.range(1).select(F.lit(3).alias("place"), F.lit("synthetic").alias("kind"), F.lit(total).cast("long").alias("papers"), F.lit(0.88).alias("confidence"), F.array().cast("array<string>").alias("quotes"))
        made = made.unionByName(one)
    return made.select(F.row_number().over(Window.orderBy("place")).alias("gap_id"), "kind", "papers", "confidence", "quotes")  # at most four rows
