"""Queries of the extraction chain: real rules and cues over sentences of papers, up to the evidence graph, with SQL."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import evidence as E
from ..operators import extraction as X
from ..operators import graph as G
from ..operators import resolve as D
from ..operators import sentences as S
from ..session import table, written
from ..sources import tables

r6 = lambda *names: [F.round(F.col(n), 6).alias(n) for n in names]


class Chain:
    """The frames of one extraction, each computed when first read; what several others read is written once."""

    def __init__(self, spark, d):
        self.sentences = tables.scholarly(spark, d)
        self.papers = self.sentences.groupBy("paper_id").agg(F.concat(F.lit("Paper "), F.col("paper_id").cast("string")).alias("title"), (F.lit(2020) + F.col("paper_id") % 6).alias("year"))

    chosen = cached_property(lambda self: written(S.top_per_category(self.sentences), "chosen"))
    method_scan = cached_property(lambda self: written(X.method_scan(self.chosen, self.sentences), "methods"))
    dataset_scan = cached_property(lambda self: written(X.dataset_scan(self.chosen, self.sentences), "datasets"))
    methods = cached_property(lambda self: X.methods(self.method_scan))
    datasets = cached_property(lambda self: X.datasets(self.dataset_scan))
    claims = cached_property(lambda self: X.claims(self.chosen, self.sentences))
    entities = cached_property(lambda self: written(X.entities(self.methods, self.datasets), "entities"))
    findings = cached_property(lambda self: X.findings(self.claims, self.entities))
    limitations = cached_property(lambda self: X.limitations(self.claims, self.entities))
    future = cached_property(lambda self: X.future_work(self.claims))


def checked(spark, d):
    """Entities judged by their quotes."""
    return E.validated(Chain(spark, d).entities)


def accepted(c):
    return E.validated(c.entities).where("status = 'ACCEPTED'").select("entity_id", "paper_id")


def cleaned_relations(spark, d):
    c = Chain(spark, d)
    ids = accepted(c).select(F.col("entity_id").alias("id"))
    return E.cascade(X.relations(c.entities), ids, ["source_id", "target_id"]).select("relation_id", "source_id", "target_id")


def cleaned_claims(spark, d):
    c = Chain(spark, d)
    some = accepted(c)
    found = X.accepted_only(c.findings, ["methods", "datasets", "baselines"], some).select("claim_id", F.array_join("methods", ",").alias("methods"), F.array_join("datasets", ",").alias("datasets"))
    limits = X.accepted_only(c.limitations, ["affected"], some).select("claim_id", F.array_join("affected", ",").alias("methods"), F.lit("").alias("datasets"))
    return found.unionByName(limits)


def nodes(spark, d):
    c = Chain(spark, d)
    made = X.graph_nodes(c.papers, c.entities, c.findings, c.limitations, c.future)
    return made.select("node_id", "node_type", "name", "paper_id", F.col("attributes")["category"].alias("category"), F.col("attributes")["role"].alias("role"), F.col("attributes")["direction"].alias("direction"))


def edges(spark, d):
    c = Chain(spark, d)
    return G.numbered(X.graph_edges(c.entities, c.findings, c.limitations, c.future)).select("edge_id", "source_id", "target_id", "relation_type", "paper_id", *r6("confidence"))


def consolidated(spark, d):
    """Names of parts and, behind them, phrases that the families know."""
    phrase = F.element_at(F.array(*map(F.lit, tables.PHRASES)), (F.col("p_partkey") % len(tables.PHRASES) + 1).cast("int"))
    names = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), phrase).alias("name"))
    return D.consolidated_datasets(D.consolidated_methods(names).withColumnRenamed("consolidated", "method")).select(
        "p_partkey", "method", "family", "category", "replaces", F.col("consolidated").alias("dataset"), "modality")


def claim_rows(spark, d):
    return Chain(spark, d).claims.select("paper_id", "kind", "idx", "text", "category", "metric", "value", "sentence_id")


QUERIES = {
    "real_section_topn": lambda s, d: Chain(s, d).chosen.select("paper_id", "category", F.col("rank").cast("long").alias("rank"), "seq"),
    "extracted_methods": lambda s, d: Chain(s, d).methods.select("paper_id", "idx", "name", "type", "role", "sentence_id", "page", "section", "quote"),
    "extracted_datasets": lambda s, d: Chain(s, d).datasets.select("paper_id", "target", "idx", "name", "modality", "usage", "sentence_id", "quote"),
    "extracted_claims": claim_rows,
    "evidence_triplets": lambda s, d: (lambda c: X.triplets(c.method_scan, c.dataset_scan))(Chain(s, d)).select("paper_id", "subject", "predicate", "object", "confidence", "sentence_id"),
    "entity_build": lambda s, d: Chain(s, d).entities.select("entity_id", "raw_name", "canonical_name", "entity_type", "subtype", "role", "sentence_id", *r6("composite")),
    "entity_validation": lambda s, d: checked(s, d).select("entity_id", "status", "reason", *r6("adjusted"), "rerouted"),
    "evaluated_on_relations": lambda s, d: X.relations(Chain(s, d).entities).select("relation_id", "source_id", "target_id", "evidence_sentence_id", "quote", *r6("confidence")),
    "finding_links": lambda s, d: Chain(s, d).findings.select("claim_id", "claim_type", F.array_join("methods", ",").alias("methods"), F.array_join("datasets", ",").alias("datasets"), "metric", "value", "direction"),
    "limitation_links": lambda s, d: Chain(s, d).limitations.select("claim_id", "category", F.array_join("affected", ",").alias("affected"), *r6("composite")),
    "cleaned_relations": cleaned_relations,
    "cleaned_claims": cleaned_claims,
    "claim_graph_nodes": nodes,
    "claim_graph_edges": edges,
    "family_consolidate": consolidated,
}


# ---- the same in SQL

def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(map(text, values))


def generic(c: str) -> str:
    bare = f"lower(trim(regexp_replace({c}, '[^a-zA-Z0-9\\s]', '', 'g')))"
    return f"({bare} IN ({listed(V.GENERIC_NOUNS + V.GENERIC_PAIRS)}) OR length({bare}) < 3 OR regexp_matches({bare}, '^[0-9]+$'))"


def titled(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda x: upper(x[1]) || lower(x[2:])), '')"


def cases(c: str, rules, field: int = 1) -> str:
    return " ".join(f"WHEN regexp_matches({c}, {text('(?i)' + r[0])}) THEN {text(r[field])}" for r in rules)


def normal(c: str, rules) -> str:
    bare = f"trim(regexp_replace(trim({c}), '^[\"`'']+|[\"`'']+$', '', 'g'))"
    return f"CASE WHEN {generic(c)} THEN '' {cases(f'trim({c})', rules)} WHEN length({bare}) < 35 THEN {titled(bare)} ELSE {bare} END"


def holds(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {text(w)})" for w in words) + ")"


def composite(values) -> str:
    return repr(round(sum(w * v for w, v in zip((0.35, 0.25, 0.25, 0.15), values)), 6)) + "::DOUBLE"


def scan(name: str, categories: list[str], first: int, rules, named: bool) -> str:
    turns = " ".join(f"WHEN {text(c)} THEN {i}" for i, c in enumerate(categories, 1))
    more = f" UNION ALL SELECT paper_id, {len(categories) + 1}, seq, seq FROM s WHERE seq <= {first}" if first else ""
    found = [f"{{'ord': {i}, 'raw': CASE WHEN regexp_matches(text, {text('(?i)' + r[0])}) THEN {text(r[1])} END, 'own': false}}" for i, r in enumerate(rules)]
    if named:
        found.append(f"{{'ord': {len(rules)}, 'raw': nullif(trim(regexp_extract(text, {text(V.PROPOSAL)}, 1)), ''), 'own': true}}")
    return f"""
{name}_c AS (SELECT paper_id, CASE category {turns} END AS turn, rank AS pos, seq FROM chosen WHERE category IN ({listed(categories)}){more}),
{name}_h AS (SELECT paper_id, turn, pos, seq, section, substr(text, 1, 120) AS quote, unnest(list_filter([{", ".join(found)}], lambda x: x.raw IS NOT NULL)) AS h FROM {name}_c JOIN s USING (paper_id, seq)),
{name}_k AS (SELECT paper_id, turn, pos, seq, section, quote, h.raw AS raw, h.ord AS ord, h.own AS own, row_number() OVER (PARTITION BY paper_id, h.raw ORDER BY turn, pos, h.ord) AS k FROM {name}_h),
{name} AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY turn, pos, ord, raw) AS idx, raw, own, 'S' || seq AS sentence_id, CAST((seq - 1) // 4 + 1 AS INTEGER) AS page, section, quote FROM {name}_k WHERE k = 1 AND NOT {generic('raw')})"""


def pattern_of(category: str) -> str:
    return "|".join(f"(?:{p})" for p in V.SECTIONS[category])


def score(category: str) -> str:
    bonus = f"WHEN kind = {text(category)} THEN 3.0" + (" WHEN kind = 'abstract_intro' THEN 1.5" if category in ("methods", "limitations") else "")
    count = " + ".join(f"len(regexp_extract_all(lower(text), {text(p)}))" for p in V.CUES[category]) or "0"
    return f"SELECT paper_id, seq, {text(category)} AS category, CASE {bonus} ELSE 0.0 END + 2.0 * ({count}) - CASE WHEN w < 6 OR w > 60 THEN 1.0 ELSE 0.0 END AS score FROM t"


N, M = len(tables.SECTIONS), len(tables.PHRASES)
SENTS = f"""WITH s AS (SELECT conv_id AS paper_id, CAST(turn + 1 AS INTEGER) AS seq, [{listed(tables.SECTIONS)}][(conv_id + turn + 1) % {N} + 1] AS section,
  [{listed(tables.PHRASES)}][(conv_id * 7 + (turn + 1) * 5) % {M} + 1] || ' ' || regexp_replace(coalesce(text, ''), '[^ -~]', 'x', 'g') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(lower(trim(section)), {text(pattern_of(c))}) THEN {text(c)}" for c in V.SECTIONS)} ELSE 'other' END AS kind,
  len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM s),
scores AS ({" UNION ALL ".join(map(score, V.CATEGORIES))}),
chosen AS (SELECT paper_id, category, rank, seq FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, category ORDER BY score DESC, seq) AS rank FROM scores WHERE score > 1.0) WHERE rank <= 8)"""
_methods = ["methods", "abstract_intro"]
METHODS = SENTS + "," + scan("ms", _methods, X.FIRST, V.METHOD_NAMES, True) + f""",
m_n AS (SELECT *, {normal('raw', V.METHOD_NAMES)} AS name, CASE WHEN own THEN 'framework' WHEN regexp_matches(lower(raw), 'model|llm') THEN 'model' ELSE 'framework' END AS type,
  CASE WHEN own OR section IN ('Abstract', 'Methodology') THEN 'proposed' ELSE 'baseline' END AS role FROM ms WHERE lower(raw) NOT IN ({listed(V.EXTRACTOR_INDEXES)}) AND NOT regexp_matches(lower(raw), '\\bet\\s+al\\.?\\b')),
m AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY idx) AS idx, name, type, role, sentence_id, page, section, quote FROM m_n WHERE name <> '' AND NOT {generic('name')})"""
_index = holds("lower(raw)", V.EXTRACTOR_INDEXES)
_data = scan("ds", ["datasets", "findings"], 0, V.DATASET_NAMES, False) + f""",
d_n AS (SELECT *, {_index} AS lit, CASE WHEN {_index} THEN {titled('raw')} ELSE {normal('raw', V.DATASET_NAMES)} END AS name FROM ds),
d AS (SELECT paper_id, CASE WHEN lit THEN 'literature_source' ELSE 'dataset' END AS target, row_number() OVER (PARTITION BY paper_id, lit ORDER BY idx) AS idx, raw, name,
  CASE WHEN lit THEN NULL WHEN regexp_matches(lower(raw), 'kdd|nsl') THEN 'tabular' ELSE 'multimodal' END AS modality, CASE WHEN NOT lit THEN 'evaluation' END AS usage, sentence_id, page, section, quote
  FROM d_n WHERE lit OR (name <> '' AND NOT {generic('name')}))"""
DATASETS = SENTS + "," + _data
CLAIMS_SQL = f"""
c_n AS (SELECT paper_id, CASE category WHEN 'limitations' THEN 'limitation' WHEN 'findings' THEN 'finding' ELSE category END AS kind, rank, seq, text, section FROM chosen JOIN s USING (paper_id, seq)
  WHERE (category = 'limitations' AND rank <= 4 AND length(text) > 20) OR (category = 'future_work' AND rank <= 3 AND length(text) > 20) OR (category = 'findings' AND rank <= 3)),
c AS (SELECT paper_id, kind, row_number() OVER (PARTITION BY paper_id, kind ORDER BY rank) AS idx, substr(text, 1, 200) AS text,
  CASE kind WHEN 'limitation' THEN CASE WHEN contains(lower(text), 'general') THEN 'generalization' ELSE 'computational_cost' END WHEN 'future_work' THEN 'methodological_extension' END AS category,
  CASE WHEN kind = 'finding' THEN nullif(regexp_extract(text, {text(V.MEASURE)}, 1), '') END AS value, 'S' || seq AS sentence_id, substr(text, 1, 120) AS quote FROM c_n)"""
ENTITIES = METHODS + "," + _data + f""",
e AS (SELECT 'ent_' || paper_id || '_m_' || idx AS entity_id, paper_id, name AS raw_name, name AS canonical_name, 'method' AS entity_type, type AS subtype, role, idx, sentence_id, quote, {composite(X.CONFIDENCE['method'])} AS composite FROM m
  UNION ALL SELECT 'ent_' || paper_id || '_d_' || idx, paper_id, name, name, 'dataset', modality, usage, idx, sentence_id, quote, {composite(X.CONFIDENCE['dataset'])} FROM d WHERE target = 'dataset'
  UNION ALL SELECT 'ent_' || paper_id || '_ls_' || idx, paper_id, raw, name, 'literature_source', 'index', 'database', idx, sentence_id, quote, {composite(X.CONFIDENCE['literature_source'])} FROM d WHERE target = 'literature_source')"""
_signs = f"({holds('low', V.DATASET_SIGNS)} OR {holds('q', V.DATASET_SIGNS)})"
_lit = f"(clean IN ({listed(V.LITERATURE_INDEXES)}) OR {holds('clean', V.LITERATURE_INDEXES)})"
VALID = ENTITIES + f""",
v_n AS (SELECT *, trim(raw_name) AS raw, lower(trim(raw_name)) AS low, trim(regexp_replace(lower(trim(raw_name)), '[^\\w\\s-]', '', 'g')) AS clean, lower(coalesce(quote, '')) AS q FROM e),
v_t AS (SELECT *, list_filter(regexp_split_to_array(clean, '[\\s\\-_]+'), lambda x: length(x) > 2) AS tokens FROM v_n),
v AS (SELECT entity_id, paper_id, composite, CASE WHEN {" OR ".join(f"regexp_matches(raw, {text(p)})" for p in V.NUMERIC)} THEN 'number' WHEN clean IN ({listed(V.FUNCTION_WORDS)}) THEN 'function_word' WHEN length(clean) <= 2 THEN 'short'
  WHEN regexp_matches(raw, {text(V.PERSON)}) AND NOT {holds('low', V.METHOD_SIGNS)} AND NOT {holds('low', V.DATASET_SIGNS)} THEN 'person'
  WHEN {_lit} AND entity_type = 'dataset' AND ({holds('q', V.SEARCH_SIGNS)} OR clean IN ({listed(V.LITERATURE_INDEXES)})) THEN 'rerouted'
  WHEN len(tokens) > 0 AND len(list_filter(tokens, lambda x: contains(q, x))) / len(tokens) < 0.5 THEN 'not_grounded'
  WHEN entity_type = 'dataset' AND NOT {_signs} AND len(regexp_split_to_array(clean, '\\s+')) > 5 THEN 'no_signal' ELSE 'passed' END AS reason FROM v_t),
a AS (SELECT entity_id, paper_id FROM v WHERE reason IN ('passed', 'rerouted'))"""
RELATIONS = """
r AS (SELECT 'rel_' || paper_id || '_' || row_number() OVER (PARTITION BY paper_id ORDER BY x.idx, y.idx) AS relation_id, x.entity_id AS source_id, y.entity_id AS target_id, x.sentence_id = y.sentence_id AS shared, x.sentence_id, x.quote
  FROM e x JOIN e y USING (paper_id) WHERE x.entity_type = 'method' AND x.role = 'proposed' AND y.entity_type = 'dataset')"""
FINDINGS = CLAIMS_SQL + """,
f AS (SELECT 'clm_' || c.paper_id || '_' || c.idx AS claim_id, c.paper_id, c.text, c.value, c.sentence_id,
  coalesce(list(entity_id ORDER BY e.idx) FILTER (entity_type = 'method'), []) AS methods, coalesce(list(entity_id ORDER BY e.idx) FILTER (entity_type = 'dataset'), []) AS datasets,
  CASE WHEN contains(coalesce(value, ''), '+') OR contains(lower(c.text), 'improv') OR contains(lower(c.text), 'outperform') THEN 'improvement' ELSE 'observation' END AS direction
  FROM c LEFT JOIN e ON e.paper_id = c.paper_id AND entity_type IN ('method', 'dataset') AND (contains(lower(c.text), lower(raw_name)) OR contains(lower(c.quote), lower(raw_name))) WHERE kind = 'finding' GROUP BY ALL),
l AS (SELECT 'lim_' || c.paper_id || '_' || c.idx AS claim_id, c.paper_id, c.category, c.text, c.sentence_id, coalesce(list(entity_id ORDER BY e.idx) FILTER (entity_id IS NOT NULL), []) AS affected
  FROM c LEFT JOIN e ON e.paper_id = c.paper_id AND entity_type = 'method' AND role = 'proposed' WHERE kind = 'limitation' GROUP BY ALL),
w AS (SELECT 'fw_' || paper_id || '_' || idx AS claim_id, paper_id, category, text FROM c WHERE kind = 'future_work')"""
ALL = ENTITIES + "," + FINDINGS
_join = lambda c: f"array_to_string({c}, ',')"
_known = lambda c: f"array_to_string(list_filter({c}, lambda x: x IN (SELECT entity_id FROM a)), ',')"
_fam = [("|".join(p), f, c, r) for f, c, r, p in V.METHOD_FAMILIES]
_sets = [("|".join(p), n, m) for n, m, p in V.DATASET_FAMILIES]
_noise = "(" + " OR ".join(f"regexp_matches(low, {text(p)})" for p in V.NOISE) + " OR contains(low, 'arxiv') OR length(low) < 3)"
_cut = lambda n: f"CASE WHEN length({titled('trim(name)')}) > {n} THEN substr({titled('trim(name)')}, 1, {n}) || '...' ELSE {titled('trim(name)')} END"
ORACLE_SQL = {
    "real_section_topn": SENTS + " SELECT paper_id, category, rank, seq FROM chosen",
    "extracted_methods": METHODS + " SELECT paper_id, idx, name, type, role, sentence_id, page, section, quote FROM m",
    "extracted_datasets": DATASETS + " SELECT paper_id, target, idx, name, modality, usage, sentence_id, quote FROM d",
    "extracted_claims": SENTS + "," + CLAIMS_SQL + " SELECT paper_id, kind, idx, text, category, CASE WHEN kind = 'finding' THEN CASE WHEN value IS NULL THEN 'Performance' ELSE 'Empirical Metric' END END AS metric, value, sentence_id FROM c",
    "evidence_triplets": METHODS + "," + _data + f" SELECT paper_id, coalesce(nullif({normal('ms.raw', V.METHOD_NAMES)}, ''), ms.raw) AS subject, 'EVALUATED_ON' AS predicate, coalesce(nullif({normal('ds.raw', V.DATASET_NAMES)}, ''), ds.raw) AS object, 0.88::DOUBLE AS confidence, ds.sentence_id FROM ms JOIN ds USING (paper_id) WHERE ms.idx = 1 AND ds.idx = 1",
    "entity_build": ENTITIES + " SELECT entity_id, raw_name, canonical_name, entity_type, subtype, role, sentence_id, composite FROM e",
    "entity_validation": VALID + " SELECT entity_id, CASE WHEN reason IN ('passed', 'rerouted') THEN 'ACCEPTED' WHEN reason = 'no_signal' THEN 'FLAGGED' ELSE 'REJECTED' END AS status, reason, CASE reason WHEN 'passed' THEN composite WHEN 'rerouted' THEN 0.98 WHEN 'no_signal' THEN 0.65 WHEN 'not_grounded' THEN 0.1 ELSE 0.0 END AS adjusted, CASE WHEN reason = 'rerouted' THEN 'literature_source' END AS rerouted FROM v",
    "evaluated_on_relations": ENTITIES + "," + RELATIONS + f" SELECT relation_id, source_id, target_id, CASE WHEN shared THEN sentence_id END AS evidence_sentence_id, CASE WHEN shared THEN quote END AS quote, CASE WHEN shared THEN {composite((0.90, 0.88, 1.0, 0.85))} ELSE {composite((0.75, 0.88, 0.80, 0.85))} END AS confidence FROM r",
    "finding_links": ALL + f" SELECT claim_id, 'performance' AS claim_type, {_join('methods')} AS methods, {_join('datasets')} AS datasets, CASE WHEN value IS NULL THEN 'Performance' ELSE 'Empirical Metric' END AS metric, TRY_CAST(regexp_extract(value, {text(V.NUMBER)}) AS DOUBLE) AS value, direction FROM f",
    "limitation_links": ALL + f" SELECT claim_id, category, {_join('affected')} AS affected, {composite(X.CLAIMS['limitation'])} AS composite FROM l",
    "cleaned_relations": VALID + "," + RELATIONS + " SELECT relation_id, source_id, target_id FROM r WHERE source_id IN (SELECT entity_id FROM a) AND target_id IN (SELECT entity_id FROM a)",
    "cleaned_claims": VALID + "," + FINDINGS + """, p AS (SELECT claim_id, 'm' AS side, unnest(methods) AS x FROM f UNION ALL SELECT claim_id, 'd', unnest(datasets) FROM f UNION ALL SELECT claim_id, 'm', unnest(affected) FROM l),
k AS (SELECT claim_id, side, x, CAST(regexp_extract(x, '(\\d+)$', 1) AS INTEGER) AS n FROM p WHERE x IN (SELECT entity_id FROM a)), i AS (SELECT claim_id FROM f UNION ALL SELECT claim_id FROM l)
SELECT claim_id, coalesce(string_agg(x, ',' ORDER BY n) FILTER (side = 'm'), '') AS methods, coalesce(string_agg(x, ',' ORDER BY n) FILTER (side = 'd'), '') AS datasets FROM i LEFT JOIN k USING (claim_id) GROUP BY claim_id""",
    "claim_graph_nodes": ALL + """ SELECT 'paper_' || paper_id AS node_id, 'paper' AS node_type, 'Paper ' || paper_id AS name, paper_id, NULL AS category, NULL AS role, NULL AS direction FROM (SELECT DISTINCT paper_id FROM s)
UNION ALL SELECT entity_id, 'entity', raw_name, paper_id, NULL, role, NULL FROM e UNION ALL SELECT claim_id, 'finding', substr(text, 1, 80) || '...', paper_id, NULL, NULL, direction FROM f
UNION ALL SELECT claim_id, 'limitation', substr(text, 1, 80) || '...', paper_id, category, NULL, NULL FROM l UNION ALL SELECT claim_id, 'future_work', substr(text, 1, 80) || '...', paper_id, category, NULL, NULL FROM w""",
    "claim_graph_edges": ALL + f""", g AS (SELECT entity_id AS source_id, 'paper_' || paper_id AS target_id, CASE WHEN entity_type = 'method' AND role = 'proposed' THEN 'PROPOSED_BY' ELSE 'USED_IN' END AS relation_type, paper_id, composite AS confidence FROM e WHERE entity_type <> 'literature_source'
UNION ALL SELECT x.entity_id, y.entity_id, 'EVALUATED_ON', paper_id, 0.90 FROM e x JOIN e y USING (paper_id) WHERE x.entity_type = 'method' AND x.role = 'proposed' AND y.entity_type = 'dataset'
UNION ALL SELECT x.entity_id, y.entity_id, 'COMPARED_WITH', paper_id, 0.92 FROM e x JOIN e y USING (paper_id) WHERE x.entity_type = 'method' AND x.role = 'proposed' AND y.entity_type = 'method' AND y.role = 'baseline'
UNION ALL SELECT claim_id, 'paper_' || paper_id, 'REPORTED_IN', paper_id, {composite(X.CLAIMS['finding'])} FROM f UNION ALL SELECT unnest(affected), claim_id, 'LIMITED_BY', paper_id, {composite(X.CLAIMS['limitation'])} FROM l
UNION ALL SELECT 'paper_' || paper_id, claim_id, 'FUTURE_DIRECTION', paper_id, {composite(X.CLAIMS['future_work'])} FROM w)
SELECT 'edge_' || paper_id || '_' || row_number() OVER (PARTITION BY paper_id ORDER BY relation_type, source_id, target_id) AS edge_id, source_id, target_id, relation_type, paper_id, round(confidence, 6) AS confidence FROM g""",
    "family_consolidate": f"""WITH n AS (SELECT p_partkey, p_name || ' ' || [{listed(tables.PHRASES)}][p_partkey % {M} + 1] AS name FROM part), k AS (SELECT *, lower(trim(name)) AS low FROM n)
SELECT p_partkey, CASE WHEN {_noise} THEN NULL {cases('low', _fam)} ELSE {_cut(40)} END AS method, {", ".join(f"CASE WHEN {_noise} THEN NULL {cases('low', _fam, i)} ELSE {text(rest)} END AS {n}" for i, rest, n in zip((1, 2, 3), V.METHOD_REST, ("family", "category", "replaces")))},
CASE WHEN {_noise} THEN NULL {cases('low', _sets)} ELSE {_cut(35)} END AS dataset, CASE WHEN {_noise} THEN NULL {cases('low', _sets, 2)} ELSE {text(V.DATASET_REST)} END AS modality FROM k""",
}
