"""Queries over texts: sentences, headings, identifiers, rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.fixed_values import GENERIC_NOUNS, GENERIC_PAIRS
from ..operators import sentences as S
from ..session import table
from ..sources.tables import raw_papers

#: Cues and rules that the invented prose of the test tables can match.
CUES = {"methods": [r"the", r"from\s"], "datasets": [r"(?:lich|ung|keit)"], "findings": [r"(?:eaux|tion)"], "limitations": [r"ci[aeo]", r"with"]}
NAME_RULES = [(r"\b(?:rings?|washers?)\b", "Ring"), (r"\bred\b", "Red Ware"), (r"\b(?:bolts?|gears?)\b", "Drive"), (r"\bhot\s+\w+\b", "Hot Ware")]


def guarded_sql(c: str) -> str:
    for pattern, form in text.abbreviation_steps():
        c = f"regexp_replace({c}, '\\b{pattern}', '{form}', 'gi')"
    return c


NOISE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g'), '\s+', ' ', 'g'), '^\d+\s*$', ''))"
SENTENCES = f"""
WITH clean AS (SELECT doc_id AS paper_id, {NOISE_SQL} AS text FROM documents),
parts AS (SELECT paper_id, unnest(string_split(regexp_replace({guarded_sql('text')}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))) AS s, generate_subscripts(string_split(regexp_replace({guarded_sql('text')}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), 1) AS i FROM clean),
found AS (SELECT paper_id, i, replace(trim(s), chr(1), '.') AS text FROM parts),
sentences AS (SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY i) AS INTEGER) AS seq, text FROM found WHERE length(text) >= 15)
"""


def count_sql(patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in patterns) or "0"


def score_sql(category: str) -> str:
    bonus = {"abstract_intro": 3.0, "methods": 1.5, "limitations": 1.5}.get(category, 0.0)
    return f"{bonus} + 2.0 * ({count_sql(CUES.get(category, []))}) - CASE WHEN w < 6 OR w > 60 THEN 1.0 ELSE 0.0 END"


SCORES = SENTENCES + ", words AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM sentences), scores AS (" + " UNION ALL ".join(
    f"SELECT paper_id, seq, '{c}' AS category, CAST({score_sql(c)} AS DOUBLE) AS score FROM words" for c in S.V.CATEGORIES) + ")\n"


def sentences_of(spark, d):
    return S.indexed(S.whole_texts(table(spark, d, "documents")))


def sentences(spark, d):
    return sentences_of(spark, d).select("paper_id", "seq", "sentence_id", "text")


def header_carry_forward(spark, d):
    found = S.sections(S.html_blocks(table(spark, d, "pages")))
    return found.select("paper_id", F.col("block_idx").cast("long").alias("block_idx"), "section", F.length("text").cast("long").alias("chars"))


def top_sentences(spark, d):
    return S.top_per_category(sentences_of(spark, d), cues=CUES).select("paper_id", "category", F.col("rank").cast("long").alias("rank"), "seq", "score")


def titles(spark, d):
    p = raw_papers(spark, d)
    return p.select("paper_id", text.clean_title(F.col("title")).alias("clean"), text.author_token(F.col("author")).alias("author"), text.py_title(F.col("title")).alias("titled"), text.extractive_label(F.col("title")).alias("label"), F.length(text.embedding_input(F.col("title"), F.col("abstract"), blank=True)).cast("long").alias("chars"))


#: Forms that identifiers come in; the number of the document stands for {}.
DOI_FORMS = ["https://doi.org/10.{}/AB", "doi:10.{}/ab", " http://doi.org/10.{}/X ", "10.{}/y", "HTTPS://DOI.ORG/doi:10.{}/Z", "", "  "]
ARXIV_FORMS = ["http://arxiv.org/abs/2305.1{}v2", " 2305.1{}", "foo{}", "https://arxiv.org/pdf/21{}.00001", "x2305.1{}", "2101.{}v"]


def formed(forms, k):
    number = F.lpad((k % 10_000).cast("string"), 4, "0")
    return F.element_at(F.array(*(F.concat(F.lit(a), number, F.lit(b)) if "{}" in f else F.lit(f) for f in forms for a, b in [(f.split("{}") + [""])[:2]])), (k % len(forms) + 1).cast("int"))


def formed_sql(forms) -> str:
    number = "lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')"
    one = lambda f: "'" + f.replace("{}", f"' || {number} || '") + "'" if "{}" in f else f"'{f}'"
    return f"[{', '.join(map(one, forms))}][doc_id % {len(forms)} + 1]"


def identifiers(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", text.doi(formed(DOI_FORMS, k)).alias("doi"), text.arxiv_id(formed(ARXIV_FORMS, k)).alias("arxiv"))


#: Words between names that make them search phrases.
JOINTS = [" for ", " in the ", " using ", " with a ", " and ", "  On ", " For "]


def plan_terms(spark, d):
    """Strategies for phrases made of a part's whole name and type."""
    k = F.col("p_partkey")
    joint = F.element_at(F.array(*map(F.lit, JOINTS)), (k % len(JOINTS) + 1).cast("int"))
    parts = table(spark, d, "part").select("p_partkey", text.query_strategies(F.concat("p_name", joint, "p_type", F.lit(" "), "p_brand")).alias("s"))
    return parts.select("p_partkey", F.array_join("s", "|").alias("strategies"))


def canonical(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", rules.normalised(n, NAME_RULES).alias("canonical"), rules.is_generic(n).alias("generic"))


def generic_names(spark, d):
    word = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")
    return word.groupBy(rules.is_generic(F.col("word")).alias("generic")).agg(F.count(F.lit(1)).alias("n"))


def index_text(spark, d):
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    index = table(spark, d, "documents").select("doc_id", F.map_from_entries(text.grouped(words)).alias("m")).where("m IS NOT NULL")
    return index.select("doc_id", text.inverted_index_text(F.col("m")).alias("text"))


#: Headings in many spellings, behind a page's number.
HEADINGS = [
    "Introduction", "Proposed Framework", "Datasets and Results", "RESULTS", "Discussion", "Future Work", "Appendix", "Methodology", "An overview of methods", "Model Architecture",
    "Ablation Study", "threats to validity", "Data", "data source", "Experimental Settings", "Cohorts", "Broader Impacts", "Concluding Remarks", "Methodical", "System Design",
]


def categories(spark, d):
    c = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("page_id") % len(HEADINGS) + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", rules.category_of(F.concat(F.col("page_id").cast("string"), F.lit(" "), c)).alias("category"))


_words = "list_filter({0}, lambda w: w <> '' AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS) + "))"


def half_sql(w: str) -> str:
    a, b = (f"trim(string_split(n, ' {w} ')[{i}])" for i in (1, 2))
    x, y = (_words.format(f"regexp_split_to_array({c}, '\\s+')") for c in (a, b))
    return f"WHEN contains(lower(n), ' {w} ') AND contains(n, ' {w} ') THEN [{a} || ' ' || {b}] || CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN [({x})[-1] || ' ' || ({y})[1]] ELSE [] END"


def distinct_sql(c: str) -> str:
    """A list's distinct entries in order."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


PLAN = f"""WITH p AS (SELECT p_partkey, trim(regexp_replace(p_name || {JOINTS!r}[p_partkey % {len(JOINTS)} + 1] || p_type || ' ' || p_brand, '\\s+', ' ', 'g')) AS n FROM part),
w AS (SELECT *, {_words.format("regexp_split_to_array(n, '[^a-zA-Z0-9]')")} AS w FROM p),
h AS (SELECT *, CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS whole, CASE {" ".join(half_sql(x) for x in ("for", "in", "using", "with"))} ELSE [] END AS halves,
  CASE WHEN len(w) > 3 THEN [array_to_string(w[1:3], ' '), array_to_string(w[-3:], ' ')] ELSE [] END AS ends FROM w),
u AS (SELECT *, list_filter(list_transform(whole || halves || ends, lambda s: trim(s)), lambda s: s <> '') AS every FROM h),
v AS (SELECT *, {distinct_sql("every")} AS once FROM u),
z AS (SELECT *, once || CASE WHEN len(once) < 5 AND len(w) >= 2 THEN [w[1] || ' ' || w[-1]] ELSE [] END AS more FROM v)
SELECT p_partkey, array_to_string(({distinct_sql("more")})[1:5], '|') AS strategies FROM z"""
_open = "regexp_replace(regexp_replace(y, '(?i)<br\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
UNESCAPED = _open
for _name, _sign in S.ENTITIES:
    UNESCAPED = f"replace({UNESCAPED}, '{_name}', chr({ord(_sign)}))"
_py = "array_to_string(list_transform(regexp_extract_all({0}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '')"
_lists = ", ".join(f"'{w}'" for w in GENERIC_NOUNS + GENERIC_PAIRS)
_generic = "(lower(trim(regexp_replace({0}, '[^a-zA-Z0-9\\s]', '', 'g'))) IN (" + _lists + ") OR length(trim(regexp_replace({0}, '[^a-zA-Z0-9\\s]', '', 'g'))) < 3 OR regexp_matches(trim(regexp_replace({0}, '[^a-zA-Z0-9\\s]', '', 'g')), '^[0-9]+$'))"
_cases = " ".join(f"WHEN regexp_matches(p_name, '(?i){p}') THEN '{n}'" for p, n in NAME_RULES)
QUERIES = {
    "sentences": sentences,
    "header_carry_forward": header_carry_forward,
    "sentence_scores": lambda s, d: S.scored(sentences_of(s, d), CUES),
    "section_topn": top_sentences,
    "candidate_context": lambda s, d: S.context(sentences_of(s, d), cues=CUES),
    "title_functions": titles,
    "doi_arxiv_normalize": identifiers,
    "query_plan_terms": plan_terms,
    "rule_canonicalize": canonical,
    "generic_name_filter": generic_names,
    "inverted_index_text": index_text,
    "section_categories": categories,
}
ORACLE_SQL = {
    "sentences": SENTENCES + "SELECT paper_id, seq, 'S' || seq AS sentence_id, text FROM sentences",
    "sentence_scores": SCORES + "SELECT paper_id, seq, category, score FROM scores",
    "section_topn": SCORES + "SELECT paper_id, category, rank, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, category ORDER BY score DESC, seq) AS rank FROM scores WHERE score > 1.0) WHERE rank <= 8",
    "header_carry_forward": f"""WITH r AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{S.HIDDEN}', ' ', 'g'), '{S.BLOCK}', 1) AS x FROM pages),
b AS (SELECT page_id, unnest(x) AS y, generate_subscripts(x, 1) - 1 AS i FROM r), e AS (SELECT page_id, i, {UNESCAPED} AS text FROM b), c AS (SELECT page_id, i, {NOISE_SQL} AS text FROM e), """ + r"""h AS (SELECT *, CASE WHEN regexp_matches(text, '^(?:\d+|[IVXLCDM]+)?\.?\s*([A-Z][A-Za-z\s]{2,40})$') AND len(regexp_split_to_array(trim(text), '\s+')) <= 6
  THEN trim(regexp_extract(text, '^(?:\d+|[IVXLCDM]+)?\.?\s*([A-Z][A-Za-z\s]{2,40})$', 1)) END AS heading FROM c WHERE text <> '')
SELECT page_id AS paper_id, i AS block_idx, section, length(text) AS chars FROM (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Abstract') AS section FROM h) WHERE heading IS NULL""",
    "title_functions": f"""WITH t AS (SELECT doc_id, source, text, substr(text, 1, 60) AS title FROM documents),
u AS (SELECT *, regexp_replace(title, '^(?:A|An|The|Towards|On)\\s+', '') AS bare FROM t)
SELECT 'doc_' || doc_id AS paper_id, lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS clean, lower(regexp_replace(source, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS author, {_py.format('title')} AS titled,
trim(CASE WHEN contains(bare, ':') THEN string_split(bare, ':')[1] WHEN contains(lower(bare), ' for ') THEN string_split(bare, ' for ')[1] WHEN contains(lower(bare), ' via ') THEN string_split(bare, ' via ')[1]
 WHEN contains(lower(bare), ' using ') THEN string_split(bare, ' using ')[1] ELSE substr(bare, 1, 45) END, ' ') AS label, length(title) + 2 + length(text) AS chars FROM u""",
    "doi_arxiv_normalize": f"""WITH f AS (SELECT doc_id, {formed_sql(DOI_FORMS)} AS d, {formed_sql(ARXIV_FORMS)} AS a FROM documents),
g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(lower(d)), '^https://doi\\.org/', ''), '^http://doi\\.org/', ''), '^doi:', '') AS x, regexp_extract(a, '(?:abs|pdf)/(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1) AS y FROM f)
SELECT doc_id, nullif(trim(x), '') AS doi, CASE WHEN y <> '' THEN y WHEN regexp_full_match(trim(a), '\\d{{4}}\\.\\d{{4,5}}(v\\d+)?') THEN trim(a) END AS arxiv FROM g""",
    "query_plan_terms": PLAN,
    "rule_canonicalize": f"SELECT p_partkey, CASE WHEN {_generic.format('p_name')} THEN '' {_cases} ELSE {_py.format('trim(p_name)')} END AS canonical, {_generic.format('p_name')} AS generic FROM part",
    "generic_name_filter": f"SELECT {_generic.format('w')} AS generic, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1",
    "inverted_index_text": "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda w: w <> ''), ' ') AS text FROM documents WHERE regexp_matches(text, '\\p{L}')",
    "section_categories": "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{c}'" for c, ps in S.V.SECTIONS.items() for p in ps) + f" ELSE 'other' END AS category FROM (SELECT page_id, lower(page_id || ' ' || {HEADINGS!r}[page_id % {len(HEADINGS)} + 1]) AS h FROM pages)",
}
