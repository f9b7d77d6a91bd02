"""Queries of the dashboard, of extraction, and of the whole run."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import evidence as E
from ..operators import gaps, resolve, sentences, serving, trends
from ..session import table
from ..sources import tables as S
from . import analysis_queries as A
from . import evidence_queries as X
from . import literature
from . import text_queries as T

ALIASES = [(1, "ring", "Round Part"), (2, "bolt", "Fastener"), (3, "red", "Red Ware"), (4, "gears", "Drive")]
RULES = [(r"tion\b", "Action"), (r"eaux\b", "Waters"), (r"ung\b", "Process")]


def aliased(spark, d):
    known = spark.createDataFrame(ALIASES, "ord int, alias string, canonical string")
    return resolve.by_alias(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), known).select("p_partkey", "canonical")


def mentions_of_rules(spark, d):
    return E.rule_mentions(T.sentences_of(spark, d), RULES).select("paper_id", "canonical", "seq")


def cross_gaps(spark, d):
    kinds = ["generalization", "computational_cost", "interpretability", "other"]
    c = S.limitations(spark, d)
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("seq") % 4 + 1).cast("int"))
    future = c.where("seq % 3 = 0").select("paper_id", "seq", F.lit("external_validation").alias("category"), "text")
    papers = c.select("paper_id").distinct()
    found = trends.cross_paper_gaps(c.select("paper_id", "seq", kind.alias("category"), "text"), future, papers, 25.0)
    return found.select(F.col("gap_id").cast("long").alias("gap_id"), "kind", "papers", "confidence", F.md5(F.array_join("quotes", "|")).alias("quotes"))


def whole_run(spark, d):
    found = literature.run(A.with_ids(spark, d), "the and thing of with", 60, method_rules=RULES, dataset_rules=RULES, cues=T.CUES, themes=A.THEMES)
    return found.themes.select("theme_id", "papers", "status")


def limits(spark, d):
    n = table(spark, d, "orders").select("o_orderkey", serving.round_limits((F.col("o_orderkey") % 300).cast("int")).alias("x"))
    return n.select("o_orderkey", "x.enough", "x.per_source")


def labels(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("label"))
    return serving.duplicate_labels(names, 0.5)


def prompts(spark, d):
    found = T.sentences_of(spark, d)
    return sentences.prompt_blocks(sentences.top_per_category(found, 3, T.CUES), found).select("paper_id", F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("prompt"))


def fallback(spark, d):
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("abstract"))
    blocks = sentences.whole_texts(table(spark, d, "documents").where("doc_id % 2 = 0"))
    found = sentences.with_fallback(blocks, papers)
    return found.select("paper_id", "section", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text"))


QUERIES = {
    "alias_map": aliased,
    "rule_mentions": mentions_of_rules,
    "named_proposals": lambda s, d: E.named_proposals(S.scholarly(s, d)).select("paper_id", "seq", "name"),
    "prompt_blocks": prompts,
    "abstract_fallback": fallback,
    "cross_paper_gaps": cross_gaps,
    "mention_frequency": lambda s, d: serving.mention_frequency(S.mentions(s, d), S.papers(s, d)),
    "fallback_gaps": lambda s, d: serving.fallback_gaps(S.limitations(s, d)).select("paper_id", "seq"),
    "filter_links": lambda s, d: serving.filter_links(gaps.evidence_links(A.limits(s, d)), relation="CONFIRMS", words="compute"),
    "status_counts": lambda s, d: serving.status_counts(A.themes(s, d)),
    "gap_roadmap": lambda s, d: gaps.roadmap(A.themes(s, d)).select("theme_id", "papers"),
    "round_limits": limits,
    "duplicate_labels": labels,
    "literature_run": whole_run,
}
PART = "SELECT p_partkey, lower(trim(p_name)) AS k FROM part"
ORACLE_SQL = {
    "alias_map": "WITH a(ord, alias, canonical) AS (VALUES (1, 'ring', 'Round Part'), (2, 'bolt', 'Fastener'), (3, 'red', 'Red Ware'), (4, 'gears', 'Drive')), m AS (SELECT p_partkey, arg_min(canonical, ord) AS canonical FROM part JOIN a ON length(alias) >= 4 AND (contains(lower(trim(p_name)), alias) OR contains(alias, lower(trim(p_name)))) GROUP BY 1)\nSELECT p_partkey, coalesce(m.canonical, array_to_string(list_transform(regexp_extract_all(trim(p_name), '(\\p{L}+|[^\\p{L}]+)'), lambda x: upper(x[1]) || lower(x[2:])), '')) AS canonical FROM part LEFT JOIN m USING (p_partkey)",
    "abstract_fallback": f"SELECT doc_id AS paper_id, 'Abstract' AS section, length({T.NOISE_SQL}) AS chars, md5({T.NOISE_SQL}) AS text FROM documents",
    "rule_mentions": T.SENTENCES + ", h AS (" + " UNION ALL ".join(f"SELECT paper_id, '{n}' AS canonical, seq FROM sentences WHERE regexp_matches(text, '(?i){p[:-2]}([^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]|$)')" for p, n in RULES) + ") SELECT paper_id, canonical, min(seq) AS seq FROM h GROUP BY 1, 2",
    "named_proposals": X.SENTS + f", n AS (SELECT paper_id, seq, trim(regexp_extract(text, {X.text(X.V.PROPOSAL)}, 1)) AS name FROM s) SELECT * FROM n WHERE name <> ''",
    "prompt_blocks": T.SCORES + f""", k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, category ORDER BY score DESC, seq) AS rank FROM scores WHERE score > 1.0),
b AS (SELECT paper_id, list_position({sentences.V.CATEGORIES!r}, category) AS place, '=== ' || upper(category) || ' ===' || chr(10) || string_agg('[S' || seq || '] (p.1, Abstract): ' || text, chr(10) ORDER BY rank) AS body
  FROM k JOIN sentences USING (paper_id, seq) WHERE rank <= 3 AND category <> 'literature_sources' GROUP BY paper_id, category),
p AS (SELECT paper_id, string_agg(body, chr(10) || chr(10) ORDER BY place) AS prompt FROM b GROUP BY paper_id) SELECT paper_id, length(prompt) AS chars, md5(prompt) AS prompt FROM p""",
    "cross_paper_gaps": """WITH c AS (SELECT conv_id AS p, turn AS seq, text, turn % 4 AS k, turn % 3 = 0 AS f FROM conversations),
r AS (SELECT 1 AS place, 0 AS side, p, seq, text FROM c WHERE k = 0 UNION ALL SELECT 1, 1, p, seq, text FROM c WHERE f UNION ALL SELECT 2, 0, p, seq, text FROM c WHERE k = 1 UNION ALL SELECT 4, 0, p, seq, text FROM c WHERE k = 2),
n AS (SELECT *, row_number() OVER (PARTITION BY place, side ORDER BY p NULLS FIRST, seq NULLS FIRST) AS n FROM r),
q AS (SELECT place, md5(array_to_string(list_slice(list(text ORDER BY side, n) FILTER (n <= 3), 1, 4), '|')) AS quotes, count(DISTINCT p) AS papers FROM n GROUP BY 1),
g AS (SELECT place, CASE place WHEN 1 THEN 'validation' WHEN 2 THEN 'cost' ELSE 'safety' END AS kind, papers, CASE place WHEN 1 THEN 0.94 WHEN 2 THEN 0.91 ELSE 0.92 END::DOUBLE AS confidence, quotes FROM q
  UNION ALL SELECT 3, 'synthetic', count(DISTINCT p), 0.88, md5('') FROM c)
SELECT row_number() OVER (ORDER BY place) AS gap_id, kind, papers, confidence, quotes FROM g WHERE papers >= 2""",
    "mention_frequency": "SELECT p_brand AS name, count(*) AS mentions, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS share FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "fallback_gaps": "SELECT conv_id AS paper_id, turn AS seq FROM conversations WHERE length(text) > 10 ORDER BY 1, 2 LIMIT 5",
    "filter_links": A.ORACLE_SQL["evidence_links"].replace("SELECT a.theme_id, a.paper_id AS source", "SELECT * FROM (SELECT a.theme_id, a.paper_id AS source") + ") WHERE relation = 'CONFIRMS' AND contains(theme_id, 'compute')",
    "status_counts": A.L_SQL + "SELECT status, count(*) AS n FROM z GROUP BY 1",
    "gap_roadmap": A.L_SQL + "SELECT theme_id, papers FROM z WHERE status IN ('UNADDRESSED', 'PARTIALLY_ADDRESSED') ORDER BY papers DESC, theme_id LIMIT 4",
    "round_limits": "SELECT o_orderkey, CAST(greatest(10, least(200, floor(1.5 * (o_orderkey % 300)))) AS INTEGER) AS enough, CAST(greatest(10, least(100, floor(1.2 * (o_orderkey % 300)))) AS INTEGER) AS per_source FROM orders",
}

_points = lambda words: " + ".join(f"CAST(regexp_matches(low, '{w}') AS INTEGER)" for w in words)
_any = lambda words: f"regexp_matches(low, '{'|'.join(words)}')"
_pick = lambda i, rest: "CASE " + " ".join(f"WHEN top >= 1 AND s[{n + 1}] = top THEN '{t[i]}'" for n, t in enumerate(V.THEMES)) + f" WHEN {_any(V.COST_WORDS)} THEN '{rest[0]}' WHEN {_any(V.DATA_WORDS)} THEN '{rest[1]}' ELSE '{rest[2]}' END"
REAL = X.SENTS[: X.SENTS.index("\nt AS (")] + f"""
w AS (SELECT paper_id, seq, text, 2016 + length(CAST(paper_id AS VARCHAR)) AS year, lower(text) AS low FROM s), k AS (SELECT *, [{", ".join(_points(t[2]) for t in V.THEMES)}] AS s FROM w), b AS (SELECT *, list_max(s) AS top FROM k),
t AS (SELECT paper_id, seq, text, year, {_pick(0, ("theme_compute_scaling", "theme_data_annotation", "theme_general_empirical"))} AS theme_id, {_pick(1, ("computational_cost", "data_scarcity", "general"))} AS category FROM b),
u AS (SELECT l_orderkey AS paper_id, struct_pack({", ".join(f"{c} := {c}" for c in S.SEQ)}) AS seq, p_brand AS name, CASE WHEN l_returnflag <> 'N' THEN 'uses ' || p_name END AS quote, p_type AS family FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
"""
_used = lambda name, column, k: f"{name} AS (SELECT theme_id, string_agg(x, '|' ORDER BY x) AS x FROM (SELECT theme_id, x, row_number() OVER (PARTITION BY theme_id ORDER BY x) AS n FROM (SELECT DISTINCT theme_id, {column} AS x FROM t JOIN u USING (paper_id))) WHERE n <= {k} GROUP BY 1)"
ORACLE_SQL["theme_detail"] = REAL + A.L_SQL[A.L_SQL.index("g AS (SELECT theme_id"):].rstrip("\n") + f""",
{_used("me", "name", 6)}, {_used("be", "family", 4)}, c AS (SELECT theme_id, max(category) AS category FROM t GROUP BY 1),
q AS (SELECT theme_id, md5(string_agg(text, '|' ORDER BY paper_id, seq)) AS quotes FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY paper_id, seq) AS n FROM t) WHERE n <= 5 GROUP BY 1)
SELECT theme_id, category, papers, first_year, last_year, status, coalesce(me.x, '') AS methods, coalesce(be.x, '') AS benchmarks, quotes FROM z JOIN c USING (theme_id) JOIN q USING (theme_id) LEFT JOIN me USING (theme_id) LEFT JOIN be USING (theme_id)"""
ORACLE_SQL["evidence_quotes"] = REAL + f"""f AS (SELECT paper_id, arg_min(name, seq) AS method, arg_min(quote, seq) FILTER (quote IS NOT NULL) AS quote FROM u GROUP BY 1), l AS (SELECT paper_id, arg_min(text, seq) AS text FROM t GROUP BY 1),
p AS (SELECT theme_id, paper_id, min(year) AS year FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY year, paper_id) AS k FROM p)
SELECT a.theme_id, a.paper_id AS source, b.paper_id AS target, CASE WHEN b.year > a.year THEN 'PARTIALLY_ADDRESSES' WHEN f.method IS NOT NULL THEN 'EXTENDS' ELSE 'CONFIRMS' END AS relation, f.method,
  substr(l.text, 1, 250) AS source_quote, substr(coalesce(f.quote, {X.text(V.TARGET_QUOTE).replace("%s", "' || coalesce(f.method, '" + V.TARGET_METHOD + "') || '")}), 1, 250) AS target_quote
FROM r a JOIN r b ON a.theme_id = b.theme_id AND a.k = 1 AND b.k BETWEEN 2 AND 4 JOIN l ON l.paper_id = a.paper_id LEFT JOIN f ON f.paper_id = b.paper_id"""
