"""URL filter by host-suffix and path-prefix expressions, with DataFrame functions only.

A url is expanded into its host suffixes, as many as some rule has labels; they meet
the hosts of the rules by an equi-join on the first bytes of their digests, the full
digest confirming it. A suffix that is a rule's host is expanded into the path
prefixes of the lengths that this host's rules have, and host and prefix meet the
rules in the same way. Of the rules that fit, the longest (host and path, in
characters) wins. The plan is the same for five rules and for a million: lengths are
rows of a table, not expressions.

Distinct urls are expanded, so a url that a third of the rows repeat is expanded
once; their matches are written and joined back to every row. The rules are broadcast
while they are under BROADCAST_RULES rows and BROADCAST_CHARS characters; beyond that
they are written and shuffled, so that a suffix which most urls share is split.

Defined results: a null url or one without "://" has an empty host and path and
no rule; its verdict is the default. Repeated rows stay; other columns of the
input are not read. A rule with a null part or an empty host fits nothing, an empty
path fits every path; of repeated rules with different verdicts the last in
alphabetical order (block before allow) holds. Equal lengths cannot tie for one url
and host, as both rules would be the same; for different splits the longer host wins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach, table
from .shared import stage

BROADCAST_RULES, BROADCAST_CHARS = 100_000, 16_000_000
PREFIX = 8
# The rules of the contract (verdict, host, path).
RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


def suffixes(host: Column, most: int) -> Column:
    """The last 1, 2, ... labels of a host, up to most or all of them."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda n: F.array_join(F.slice(parts, -n, n), "."))


def digest(host: Column, path: Column) -> Column:
    """A host holds no slash, so their concatenation after a separator is unambiguous."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def meets(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(asked) with right(short, full): joined on short prefixes of the digests, confirmed by all of them."""
    return left.join(right, (F.substring("asked", 1, PREFIX) == F.col("short")) & (F.col("asked") == F.col("full"))).drop("asked", "short", "full")


def filter_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for every row of df; rules: (verdict, host, path)."""
    rules = rules.where("verdict IS NOT NULL AND path IS NOT NULL AND host <> ''")
    labels = F.size(F.split("host", r"\.", -1))
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("host") + F.length("path")).alias("chars"), F.max(labels).alias("most")).first()
    pages = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    if not facts["n"]:
        return pages.select("page_id", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    short = F.substring("full", 1, PREFIX).alias("short")
    one = rules.withColumn("full", digest(F.col("host"), F.col("path"))).groupBy("full").agg(F.max("verdict").alias("verdict"), F.first("host").alias("h"), F.first("path").alias("p"))
    known = one.select(short, "full", "verdict", F.concat("h", "p").alias("rule"), F.length(F.concat("h", "p")).alias("size"), F.length("h").alias("host_size"))
    # the distinct lengths of a host's rules: no more than its longest path has characters
    hosts = rules.groupBy(F.sha2("host", 256).alias("full")).agg(F.collect_set(F.length("path")).alias("lengths")).select(short, "full", "lengths")
    small = facts["n"] <= BROADCAST_RULES and facts["chars"] <= BROADCAST_CHARS
    known, hosts = (F.broadcast(x) if small else stage(x, "rules") for x in (known, hosts))
    asked = pages.where(F.col("url").isNotNull()).select("url").distinct().select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    each = asked.select("url", "path", F.explode(suffixes(F.col("host"), facts["most"])).alias("suffix"))
    able = meets(each.withColumn("asked", F.sha2("suffix", 256)), hosts)
    able = able.select("url", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    hits = meets(able.select("url", digest(F.col("suffix"), F.substr("path", F.lit(1), F.col("n"))).alias("asked")), known)
    # written, so that the join back has plain exchanges and a url that many rows repeat is split
    best = stage(hits.groupBy("url").agg(F.max(F.struct("size", "host_size", "rule", "verdict")).alias("best")), "urls")
    return pages.join(best, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages judged by the contract's rules; the method allows what no rule fits."""
    attach(spark)
    return filter_urls(table(spark, sf_dir, "pages"), contract_rules(spark))


_FITS = "(host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)"
ORACLE_SQL = {
    "op7_urls": f"""
WITH r(v, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM u),
m AS (SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict FROM s JOIN r ON {_FITS} GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (n)"""
}
QUERIES = {"op7_urls": op7_urls}
