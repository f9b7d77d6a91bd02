"""Queries over entities, papers and years."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trends as T
from ..sources import tables as S

SEQ_SQL = ", ".join(S.SEQ)
WITH = f"""
WITH papers AS (SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
mentions AS (SELECT paper_id, year, p_brand AS name, {SEQ_SQL}, l_suppkey AS supplier,
  CASE l_returnflag WHEN 'A' THEN 'proposed' WHEN 'R' THEN 'baseline' WHEN 'N' THEN 'component' END AS role
  , p_name AS alias, p_type AS family, l_linestatus AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN papers ON l_orderkey = paper_id),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, name ORDER BY {SEQ_SQL}, role) AS k FROM mentions) WHERE k = 1),
rolecounts AS (SELECT name, role, count(*) AS papers, min(paper_id) AS met FROM firsts GROUP BY name, role),
roles AS (SELECT name, role, papers FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY papers DESC, met, role) AS k FROM rolecounts) WHERE k = 1),
totals AS (SELECT year, count(*) AS total FROM papers GROUP BY year),
used AS (SELECT name, year, count(DISTINCT paper_id) AS papers FROM mentions GROUP BY name, year),
yearly AS (SELECT n.name, t.year, coalesce(u.papers, 0) AS papers, 100.0 * coalesce(u.papers, 0) / total AS share, total
  FROM (SELECT DISTINCT name FROM mentions) n CROSS JOIN totals t LEFT JOIN used u ON u.name = n.name AND u.year = t.year),
ranked AS (SELECT year, row_number() OVER (ORDER BY year) AS place, greatest(1, (SELECT count(*) FROM totals) // 2) AS half FROM totals),
halves AS (SELECT name, avg(CASE WHEN place <= half THEN papers / CAST(total AS DOUBLE) END) AS early, avg(CASE WHEN place > half THEN papers / CAST(total AS DOUBLE) END) AS late
  FROM yearly JOIN ranked USING (year) GROUP BY name),
rates AS (SELECT name, early, late, CASE WHEN early = 0 THEN CASE WHEN late > 0 THEN 100.0 ELSE 0.0 END ELSE (late - early) / early * 100.0 END AS growth FROM halves),
adopted AS (SELECT name, count(DISTINCT paper_id) AS papers, 100.0 * count(DISTINCT paper_id) / (SELECT count(*) FROM papers) AS share FROM mentions GROUP BY name),
trajectories AS (SELECT name, a.papers, a.share, role, early, late, growth,
  CASE WHEN a.share >= 30 AND late >= 0.25 THEN 'DOMINANT' WHEN early = 0 AND late > 0 AND role = 'proposed' THEN 'EMERGING'
       WHEN growth > 25 THEN 'INCREASING' WHEN growth < -25 THEN 'DECLINING' ELSE 'STABLE' END AS trajectory
  FROM adopted a JOIN roles USING (name) JOIN rates USING (name)),
uses AS (SELECT DISTINCT paper_id, name FROM mentions),
counts AS (SELECT name, count(*) AS n FROM uses GROUP BY name)
"""
LABEL = "CASE WHEN hhi >= 0.25 THEN 'Highly Concentrated Benchmarks' WHEN hhi >= 0.15 THEN 'Moderately Concentrated Benchmarks' ELSE 'Well-Diversified Benchmarks' END"
R = lambda *names: [F.round(F.col(n), 6).alias(n) for n in names]


def adoption_trajectory(spark, d):
    found = T.trajectory(S.mentions(spark, d), S.papers(spark, d))
    return found.select("name", "papers", "role", "trajectory", "confidence", *R("share", "early", "late", "growth"))


def hhi_of(column):
    def query(spark, d):
        return T.concentration(T.usage(S.mentions(spark, d, column)))
    return query


def line_status_hhi(spark, d):
    lines = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linestatus").alias("name"))
    return T.concentration(T.usage(lines))


def hhi_by_year(spark, d):
    rows = S.mentions(spark, d).select("paper_id", "year", "name").distinct()
    return T.concentration(rows, ["year"])


def affinity(spark, d):
    nations = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("paper_id"), F.col("s_nationkey").cast("long").alias("cluster_id"))
    rows = S.table(spark, d, "lineitem").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return T.cluster_affinity(nations, rows.select(F.col("l_suppkey").alias("paper_id"), F.col("p_brand").alias("name"))).select("cluster_id", F.col("rank").cast("long").alias("rank"), "name", "papers", *R("share"))


def rollup(spark, d):
    s, n, r = (S.table(spark, d, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    found = T.ontology_rollup(rows.select(F.col("r_name").alias("paradigm"), F.col("n_name").alias("family"), F.col("s_name").alias("canonical"), F.col("s_name").alias("alias"), F.col("s_suppkey").alias("paper_id")))
    return found.select("paradigm", F.coalesce("family", F.lit("*")).alias("family"), F.coalesce("canonical", F.lit("*")).alias("canonical"), "aliases", "papers")


def hhi_sql(source):
    return f"""WITH papers AS (SELECT o_orderkey AS paper_id FROM orders), c AS ({source}),
s AS (SELECT CAST(sum(n) AS BIGINT) AS uses, count(*) AS names, round(sum(n * CAST(n AS DOUBLE)) / (sum(n) * CAST(sum(n) AS DOUBLE)), 4) AS hhi FROM c)
SELECT uses, names, hhi, {LABEL} AS label FROM s"""


def brand(column):
    return f"SELECT {column} AS name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN papers ON l_orderkey = paper_id GROUP BY 1"


def shares(spark, d):
    uses = T.usage(S.mentions(spark, d))
    return T.concentration_shares(uses, S.papers(spark, d)).select(*R("top1_share", "top3_share", "synthetic_share", "single_share", "multi_share"))


def mode(spark, d):
    return T.corpus_mode(S.papers(spark, d))


def profiled(made):
    """Profiles with their lists as texts."""
    return made.withColumns({"aliases": F.array_join("aliases", "|"), "top_papers": F.array_join(F.transform("top_papers", lambda x: x.cast("string")), ",")})


def members_of(spark, d):
    """Papers in groups by their key."""
    return S.papers(spark, d).select("paper_id", (F.col("paper_id") % 11).alias("cluster_id"))


def said(spark, d):
    """Comments on parts of lines as limitations."""
    return S.mentions(spark, d).select("paper_id", F.concat_ws(" ", F.lit("limited by"), "alias", "family").alias("text"))


def clusters_in_detail(spark, d):
    made = T.cluster_profiles(members_of(spark, d), S.mentions(spark, d), said(spark, d))
    return made.withColumn("limitations", F.array_join("limitations", "|"))


QUERIES = {
    "method_profiles": lambda s, d: profiled(T.method_profiles(S.mentions(s, d), S.papers(s, d))),
    "dataset_profiles": lambda s, d: profiled(T.dataset_profiles(S.mentions(s, d), S.papers(s, d), ["blue", "washer"])),
    "cluster_profiles": clusters_in_detail,
    "adoption_trajectory": adoption_trajectory,
    "adoption_by_year": lambda s, d: T.yearly_totals(S.papers(s, d)),
    "yearly_distribution": lambda s, d: T.yearly_distribution(S.mentions(s, d), S.papers(s, d)).select("name", "year", "papers", *R("share")),
    "primary_role": lambda s, d: T.primary_role(S.mentions(s, d)),
    "growth_rate": lambda s, d: T.growth(S.mentions(s, d), S.papers(s, d)).select("name", *R("early", "late", "growth")),
    "emerging_topk": lambda s, d: T.emerging(S.mentions(s, d, "p_partkey"), S.papers(s, d)).select("name", "papers", "trajectory"),
    "usage_hhi": hhi_of("p_brand"),
    "usage_hhi_moderate": hhi_of("p_type"),
    "usage_hhi_high": line_status_hhi,
    "hhi_by_year": hhi_by_year,
    "concentration_shares": shares,
    "monopoly_flags": lambda s, d: T.monopolies(T.usage(S.mentions(s, d)), S.papers(s, d)).select("name", "papers", "monopoly", *R("share")),
    "cluster_affinity_topk": affinity,
    "ontology_rollup": rollup,
    "corpus_mode": mode,
}
FIRST_TEN = "string_agg(CASE WHEN k10 <= 10 THEN CAST(paper_id AS VARCHAR) END, ',' ORDER BY paper_id)"
ORACLE_SQL = {
    "method_profiles": WITH + f""", f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY paper_id) AS k10 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, name ORDER BY {SEQ_SQL}, role, alias, family, kind) AS j FROM mentions) WHERE j = 1)),
g AS (SELECT name, arg_max(family, paper_id) AS family, arg_max(kind, paper_id) AS kind, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases, count(*) AS papers, {FIRST_TEN} AS top_papers FROM f GROUP BY name)
SELECT name, family, kind, role, aliases, g.papers, round(100.0 * g.papers / (SELECT count(*) FROM papers), 2) AS share, top_papers FROM g JOIN roles USING (name)""",
    "dataset_profiles": WITH + f""", m AS (SELECT * FROM mentions WHERE NOT contains(lower(alias), 'blue') AND NOT contains(lower(alias), 'washer')),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY paper_id) AS k10 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, name ORDER BY {SEQ_SQL}, alias, family) AS j FROM m) WHERE j = 1)),
g AS (SELECT name, arg_max(family, paper_id) AS modality, bool_or(regexp_matches(lower(alias), 'synth|simulat')) AS synthetic, count(*) AS papers, {FIRST_TEN} AS top_papers FROM f GROUP BY name),
l AS (SELECT name, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM m GROUP BY name), h AS (SELECT *, round(100.0 * papers / (SELECT count(*) FROM papers), 2) AS share FROM g)
SELECT name, modality, aliases, papers, share, share >= 25 AS monopoly, synthetic, top_papers FROM h JOIN l USING (name)""",
    "cluster_profiles": WITH + f""", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, name ORDER BY {SEQ_SQL}, family, kind) AS j FROM mentions) WHERE j = 1),
c AS (SELECT paper_id % 11 AS cluster_id, count(*) AS papers FROM papers GROUP BY 1),
a AS (SELECT cluster_id, arg_min(family, (-n, family)) AS family FROM (SELECT paper_id % 11 AS cluster_id, family, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT cluster_id, arg_min(kind, (-n, kind)) AS kind FROM (SELECT paper_id % 11 AS cluster_id, kind, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT cluster_id, text, row_number() OVER (PARTITION BY cluster_id ORDER BY text) AS k FROM (SELECT DISTINCT paper_id % 11 AS cluster_id, substr('limited by ' || alias || ' ' || family, 1, 120) AS text FROM mentions)),
l AS (SELECT cluster_id, string_agg(text, '|' ORDER BY text) AS limitations FROM t WHERE k <= 4 GROUP BY 1)
SELECT cluster_id, papers, coalesce(family, 'Specialized Methodologies') AS family, coalesce(kind, 'Adaptive Scientific AI') AS kind, coalesce(limitations, '') AS limitations FROM c LEFT JOIN a USING (cluster_id) LEFT JOIN b USING (cluster_id) LEFT JOIN l USING (cluster_id)""",
    "adoption_trajectory": WITH + """SELECT name, papers, role, trajectory,
  CASE trajectory WHEN 'DOMINANT' THEN 0.95 WHEN 'EMERGING' THEN 0.92 WHEN 'INCREASING' THEN 0.90 WHEN 'DECLINING' THEN 0.88 ELSE 0.85 END::DOUBLE AS confidence,
  round(share, 6) AS share, round(early, 6) AS early, round(late, 6) AS late, round(growth, 6) AS growth FROM trajectories""",
    "adoption_by_year": WITH + "SELECT year, total AS papers FROM totals",
    "yearly_distribution": WITH + "SELECT name, year, papers, round(share, 6) AS share FROM yearly",
    "primary_role": WITH + "SELECT name, role, papers FROM roles",
    "growth_rate": WITH + "SELECT name, round(early, 6) AS early, round(late, 6) AS late, round(growth, 6) AS growth FROM rates",
    "emerging_topk": WITH.replace("p_brand AS name", "CAST(p_partkey AS VARCHAR) AS name") + "SELECT name, papers, trajectory FROM trajectories WHERE trajectory IN ('EMERGING', 'INCREASING') ORDER BY papers DESC, name LIMIT 20",
    "usage_hhi": hhi_sql(brand("p_brand")),
    "usage_hhi_moderate": hhi_sql(brand("p_type")),
    "usage_hhi_high": hhi_sql("SELECT l_linestatus AS name, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1"),
    "hhi_by_year": WITH + f""", c AS (SELECT year, name, count(*) AS n FROM (SELECT DISTINCT paper_id, year, name FROM mentions) GROUP BY 1, 2),
s AS (SELECT year, CAST(sum(n) AS BIGINT) AS uses, count(*) AS names, round(sum(n * CAST(n AS DOUBLE)) / (sum(n) * CAST(sum(n) AS DOUBLE)), 4) AS hhi FROM c GROUP BY year)
SELECT year, uses, names, hhi, {LABEL} AS label FROM s""",
    "concentration_shares": WITH + """, top AS (SELECT n FROM counts ORDER BY n DESC, name LIMIT 3), k AS (SELECT count(*) AS c FROM uses GROUP BY paper_id)
SELECT round(100.0 * (SELECT max(n) FROM top) / (SELECT sum(n) FROM counts), 6) AS top1_share, round(100.0 * (SELECT sum(n) FROM top) / (SELECT sum(n) FROM counts), 6) AS top3_share,
  round(100.0 * (SELECT coalesce(sum(n), 0) FROM counts WHERE regexp_matches(lower(name), 'synth|simulat')) / (SELECT sum(n) FROM counts), 6) AS synthetic_share,
  round(100.0 * (SELECT count(*) FROM k WHERE c = 1) / (SELECT count(*) FROM papers), 6) AS single_share, round(100.0 * (SELECT count(*) FROM k WHERE c > 1) / (SELECT count(*) FROM papers), 6) AS multi_share""",
    "monopoly_flags": WITH + "SELECT name, papers, share >= 25 AS monopoly, round(share, 6) AS share FROM adopted",
    "cluster_affinity_topk": """WITH m AS (SELECT s_suppkey AS paper_id, CAST(s_nationkey AS BIGINT) AS cluster_id FROM supplier),
z AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY 1), u AS (SELECT DISTINCT l_suppkey AS paper_id, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT cluster_id, name, count(*) AS papers FROM m JOIN u USING (paper_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY papers DESC, name) AS rank FROM c)
SELECT cluster_id, rank, name, papers, round(100.0 * papers / size, 6) AS share FROM r JOIN z USING (cluster_id) WHERE rank <= 5""",
    "ontology_rollup": """SELECT r_name AS paradigm, coalesce(n_name, '*') AS family, coalesce(s_name, '*') AS canonical, count(DISTINCT s_name) AS aliases, count(DISTINCT s_suppkey) AS papers
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, s_name) HAVING r_name IS NOT NULL""",
    "corpus_mode": "SELECT min(CAST(year(o_orderdate) AS INTEGER)) AS first_year, max(CAST(year(o_orderdate) AS INTEGER)) AS last_year, CASE WHEN max(year(o_orderdate)) - min(year(o_orderdate)) <= 1 THEN 'SNAPSHOT' ELSE 'LONGITUDINAL' END AS mode FROM orders",
}
