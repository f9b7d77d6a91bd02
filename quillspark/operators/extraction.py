"""The extraction chain by rules: from chosen sentences to methods, datasets, claims and triplets, and on to entities,
relations and linked claims.

sentences(paper_id, seq, sentence_id, page, section, text) and chosen(paper_id, category, rank, seq) come from
operators.sentences. All windows and lists are within one paper, whose sentences and names are few.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import rules
from ..functions.numbers import composite_confidence
from ..functions.text import py_title
from . import evidence

FIRST = 30  # sentences of a paper that every scan for methods reads
SOURCE = ["sentence_id", "page", "section", "quote"]
CONFIDENCE = {"method": (0.92, 0.95, 1.0, 0.90), "dataset": (0.90, 0.90, 1.0, 0.88), "literature_source": (0.98, 0.99, 1.0, 0.95)}
TAGS = {"method": "m", "dataset": "d", "literature_source": "ls"}
CLAIMS = {"finding": (0.90, 0.90, 1.0, 0.85), "limitation": (0.90, 0.88, 1.0, 0.85), "future_work": (0.90, 0.85, 1.0, 0.85)}


def sure(values: tuple) -> Column:
    return composite_confidence(*map(F.lit, values))


def candidates(chosen: DataFrame, sentences: DataFrame, categories: list[str], first: int = 0) -> DataFrame:
    """Sentences with (turn, at): the order in which a scan reads them, chosen ones by category, then a paper's first."""
    turn = F.array_position(F.array(*map(F.lit, categories)), F.col("category")).cast("int")
    picked = chosen.where(F.col("category").isin(categories)).select("paper_id", turn.alias("turn"), F.col("rank").alias("at"), "seq")
    if first:
        picked = picked.unionByName(sentences.where(F.col("seq") <= first).select("paper_id", F.lit(len(categories) + 1).alias("turn"), F.col("seq").alias("at"), "seq"))
    return picked.join(sentences, ["paper_id", "seq"])


def scanned(rows: DataFrame, found: list[tuple], named: bool = False) -> DataFrame:
    """(paper_id, idx, raw, proposal, sentence_id, page, section, quote): each name of a paper where the scan first meets it.

    A sentence's rules come in their order, then the name that it says is proposed."""
    hits = [F.when(F.col("text").rlike("(?iU)" + r[0]), F.struct(F.lit(i).alias("ord"), F.lit(r[1]).alias("raw"), F.lit(False).alias("proposal"))) for i, r in enumerate(found)]
    if named:
        name = F.trim(F.regexp_extract("text", "(?U)" + V.PROPOSAL, 1))
        hits.append(F.when(name != "", F.struct(F.lit(len(found)).alias("ord"), name.alias("raw"), F.lit(True).alias("proposal"))))
    each = rows.select("paper_id", "turn", "at", "sentence_id", "page", "section", F.substring("text", 1, 120).alias("quote"), F.inline(F.array_compact(F.array(*hits))))
    order = ["turn", "at", "ord"]
    first = each.groupBy("paper_id", "raw").agg(F.min(F.struct(*order, "proposal", *SOURCE)).alias("m")).select("paper_id", "raw", "m.*")
    first = first.where(~rules.is_generic(F.col("raw")))
    idx = F.row_number().over(Window.partitionBy("paper_id").orderBy(*order, "raw"))
    return first.select("paper_id", idx.alias("idx"), "raw", "proposal", *SOURCE)


def renumbered(rows: DataFrame, *more: str) -> DataFrame:
    """rows with idx counted again from 1 within each paper."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("paper_id", *more).orderBy("idx")))


def method_scan(chosen: DataFrame, sentences: DataFrame) -> DataFrame:
    return scanned(candidates(chosen, sentences, ["methods", "abstract_intro"], FIRST), V.METHOD_NAMES, named=True)


def dataset_scan(chosen: DataFrame, sentences: DataFrame) -> DataFrame:
    return scanned(candidates(chosen, sentences, ["datasets", "findings"]), V.DATASET_NAMES)


def methods(scan: DataFrame) -> DataFrame:
    """(paper_id, idx, name, type, role, sentence_id, page, section, quote) of scanned methods, normalised and filtered."""
    low = F.lower("raw")
    kept = scan.where(~low.isin(V.EXTRACTOR_INDEXES) & ~low.rlike(r"(?U)\bet\s+al\.?\b"))
    kind = F.when(F.col("proposal"), "framework").otherwise(evidence.method_type(F.col("raw")))
    role = F.when(F.col("proposal"), "proposed").otherwise(evidence.method_role(F.col("section")))
    made = kept.select("paper_id", "idx", rules.normalised(F.col("raw"), V.METHOD_NAMES).alias("name"), kind.alias("type"), role.alias("role"), *SOURCE)
    return renumbered(made.where((F.col("name") != "") & ~rules.is_generic(F.col("name"))))


def datasets(scan: DataFrame) -> DataFrame:
    """(paper_id, target, idx, raw, name, modality, usage, ...): scanned datasets, literature indexes routed to sources."""
    index = rules.contains_any(F.lower("raw"), V.EXTRACTOR_INDEXES)
    name = F.when(index, py_title(F.col("raw"))).otherwise(rules.normalised(F.col("raw"), V.DATASET_NAMES))
    made = scan.select(
        "paper_id", F.when(index, "literature_source").otherwise("dataset").alias("target"), "idx", "raw", name.alias("name"),
        F.when(~index, evidence.modality(F.col("raw"))).alias("modality"), F.when(~index, F.lit("evaluation")).alias("usage"), *SOURCE)
    return renumbered(made.where((F.col("target") == "literature_source") | (F.col("name") != "") & ~rules.is_generic(F.col("name"))), "target")


def claims(chosen: DataFrame, sentences: DataFrame) -> DataFrame:
    """(paper_id, kind, idx, text, category, metric, value, sentence_id, page, section, quote) of limitations, future work, findings."""
    kinds = {"limitations": ("limitation", 4, 20), "future_work": ("future_work", 3, 20), "findings": ("finding", 3, -1)}
    rows = chosen.where(F.col("category").isin([*kinds])).select("paper_id", F.col("category").alias("from"), F.col("rank").alias("idx"), "seq").join(sentences, ["paper_id", "seq"])
    fits = reduce(lambda a, b: a | b, ((F.col("from") == k) & (F.col("idx") <= most) & (F.length("text") > least) for k, (_, most, least) in kinds.items()))
    kind = F.coalesce(*(F.when(F.col("from") == k, name) for k, (name, *_) in kinds.items()))
    general = F.when(F.contains(F.lower("text"), F.lit("general")), "generalization").otherwise("computational_cost")
    category = F.when(kind == "limitation", general).when(kind == "future_work", "methodological_extension")
    finding = kind == "finding"
    value = F.when(finding, F.nullif(F.regexp_extract("text", "(?U)" + V.MEASURE, 1), F.lit("")))
    metric = F.when(finding, F.when(value.isNotNull(), "Empirical Metric").otherwise("Performance"))
    made = rows.where(fits).select(
        "paper_id", kind.alias("kind"), "idx", F.substring("text", 1, 200).alias("text"), category.alias("category"), metric.alias("metric"),
        value.alias("value"), "sentence_id", "page", "section", F.substring("text", 1, 120).alias("quote"))
    return renumbered(made, "kind")


def triplets(method_rows: DataFrame, dataset_rows: DataFrame) -> DataFrame:
    """(paper_id, subject, predicate, object, confidence, sentence_id, ...): the first scanned method and dataset of a paper."""
    m = method_rows.where("idx = 1").select("paper_id", F.col("raw").alias("m"))
    d = dataset_rows.where("idx = 1").select("paper_id", F.col("raw").alias("d"), *SOURCE)
    canon = lambda c, table: F.coalesce(F.nullif(rules.normalised(F.col(c), table), F.lit("")), F.col(c))
    return m.join(d, "paper_id").select("paper_id", canon("m", V.METHOD_NAMES).alias("subject"), F.lit("EVALUATED_ON").alias("predicate"), canon("d", V.DATASET_NAMES).alias("object"), F.lit(0.88).alias("confidence"), *SOURCE)


def entities(method_rows: DataFrame, dataset_rows: DataFrame) -> DataFrame:
    """(entity_id, paper_id, raw_name, canonical_name, entity_type, subtype, role, idx, sentence_id, page, section, quote, composite)."""
    def of(rows: DataFrame, kind: Column, raw: str, subtype: Column, role: Column) -> DataFrame:
        return rows.select("paper_id", "idx", kind.alias("entity_type"), F.col(raw).alias("raw_name"), F.col("name").alias("canonical_name"), subtype.alias("subtype"), role.alias("role"), *SOURCE)

    made = of(method_rows, F.lit("method"), "name", F.col("type"), F.col("role"))
    some = dataset_rows.where("target = 'dataset'")
    made = made.unionByName(of(some, F.lit("dataset"), "name", F.col("modality"), F.col("usage")))
    made = made.unionByName(of(dataset_rows.where("target = 'literature_source'"), F.lit("literature_source"), "raw", F.lit("index"), F.lit("database")))
    pick = lambda values: F.coalesce(*(F.when(F.col("entity_type") == k, v) for k, v in values))
    tag = pick([(k, F.lit(t)) for k, t in TAGS.items()])
    entity_id = F.concat_ws("_", F.lit("ent"), F.col("paper_id").cast("string"), tag, F.col("idx").cast("string"))
    return made.select(entity_id.alias("entity_id"), "*", pick([(k, sure(v)) for k, v in CONFIDENCE.items()]).alias("composite"))


def relations(found: DataFrame) -> DataFrame:
    """(relation_id, paper_id, source_id, target_id, relation_type, evidence_sentence_id, quote, confidence) of entities:
    proposed methods evaluated on the datasets of their paper, surer where both are named in one sentence."""
    m = found.where("entity_type = 'method' AND role = 'proposed'").select("paper_id", F.col("entity_id").alias("source_id"), F.col("idx").alias("mi"), F.col("sentence_id").alias("ms"), F.col("quote").alias("mq"))
    d = found.where("entity_type = 'dataset'").select("paper_id", F.col("entity_id").alias("target_id"), F.col("idx").alias("di"), F.col("sentence_id").alias("ds"))
    shared = F.col("ms") == F.col("ds")
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("mi", "di"))
    value = F.when(shared, sure((0.90, 0.88, 1.0, 0.85))).otherwise(sure((0.75, 0.88, 0.80, 0.85)))
    return m.join(d, "paper_id").select(
        F.concat_ws("_", F.lit("rel"), F.col("paper_id").cast("string"), number.cast("string")).alias("relation_id"), "paper_id", "source_id", "target_id",
        F.lit("evaluated_on").alias("relation_type"), F.when(shared, F.col("ms")).alias("evidence_sentence_id"), F.when(shared, F.col("mq")).alias("quote"), value.alias("confidence"))


def numbered_claims(found: DataFrame, kind: str, tag: str) -> DataFrame:
    claim_id = F.concat_ws("_", F.lit(tag), F.col("paper_id").cast("string"), F.col("idx").cast("string"))
    return found.where(F.col("kind") == kind).withColumn("claim_id", claim_id)


def in_order(rows: Column) -> Column:
    """The ids of (idx, id) pairs by idx."""
    return F.transform(F.array_sort(rows), lambda x: x["entity_id"])


def findings(found: DataFrame, known: DataFrame) -> DataFrame:
    """Findings with claim_type, numeric value, direction, and the entities of their paper that their text or quote names."""
    rows = numbered_claims(found, "finding", "clm")
    low = F.lower("text")
    direction = F.when(F.contains(F.coalesce("value", F.lit("")), F.lit("+")) | F.contains(low, F.lit("improv")) | F.contains(low, F.lit("outperform")), "improvement").otherwise("observation")
    names = known.where("entity_type IN ('method', 'dataset')").select("paper_id", "entity_type", "entity_id", F.lower("raw_name").alias("name"), F.col("idx").alias("n"))
    named = rows.join(names, "paper_id").where(F.contains(low, F.col("name")) | F.contains(F.lower("quote"), F.col("name")))
    of = lambda kind: F.collect_list(F.when(F.col("entity_type") == kind, F.struct(F.col("n"), F.col("entity_id"))))
    links = named.groupBy("claim_id").agg(in_order(of("method")).alias("methods"), in_order(of("dataset")).alias("datasets"))
    none = F.array().cast("array<string>")
    return rows.join(links, "claim_id", "left").select(
        "claim_id", "paper_id", F.when(F.col("metric").isNotNull(), "performance").otherwise("empirical").alias("claim_type"), "text",
        F.coalesce("methods", none).alias("methods"), F.coalesce("datasets", none).alias("datasets"), none.alias("baselines"), "metric",
        evidence.first_number(F.col("value")).alias("value"), direction.alias("direction"), *SOURCE, sure(CLAIMS["finding"]).alias("composite"))


def limitations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Limitations with the proposed methods of their paper as what they affect."""
    proposed = known.where("entity_type = 'method' AND role = 'proposed'").groupBy("paper_id").agg(in_order(F.collect_list(F.struct("idx", "entity_id"))).alias("affected"))
    rows = numbered_claims(found, "limitation", "lim").join(proposed, "paper_id", "left")
    return rows.select("claim_id", "paper_id", "category", "text", F.coalesce("affected", F.array().cast("array<string>")).alias("affected"), *SOURCE, sure(CLAIMS["limitation"]).alias("composite"))


def future_work(found: DataFrame) -> DataFrame:
    return numbered_claims(found, "future_work", "fw").select("claim_id", "paper_id", "category", "text", *SOURCE, sure(CLAIMS["future_work"]).alias("composite"))


def accepted_only(found: DataFrame, columns: list[str], accepted: DataFrame) -> DataFrame:
    """Claims whose lists of entity ids keep accepted(entity_id, paper_id) alone; ids of a paper meet in one list."""
    known = accepted.groupBy("paper_id").agg(F.collect_set("entity_id").alias("known"))
    rows = found.join(known, "paper_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return rows.select(*(F.filter(c, lambda x: F.array_contains("known", x)).alias(c) if c in columns else F.col(c) for c in found.columns))


def graph_nodes(papers: DataFrame, known: DataFrame, found: DataFrame, limits: DataFrame, ahead: DataFrame) -> DataFrame:
    """(node_id, node_type, name, paper_id, attributes): papers(paper_id, title, year), entities and claims; of a repeated id one row stays."""
    short = F.concat(F.substring("text", 1, 80), F.lit("..."))
    text = lambda c: F.col(c).cast("string")

    def part(rows: DataFrame, node: Column, kind: str, name: Column, **more: Column) -> DataFrame:
        held = F.map_from_arrays(F.array(*map(F.lit, more)), F.array(*more.values()))
        return rows.select(node.alias("node_id"), F.lit(kind).alias("node_type"), name.alias("name"), "paper_id", held.alias("attributes"))

    parts = [
        part(papers, F.concat(F.lit("paper_"), text("paper_id")), "paper", F.col("title"), publication_year=text("year")),
        part(known, F.col("entity_id"), "entity", F.col("raw_name"), entity_type=F.col("entity_type"), subtype=F.col("subtype"), role=F.col("role"), confidence=text("composite")),
        part(found, F.col("claim_id"), "finding", short, claim_type=F.col("claim_type"), metric=F.col("metric"), value=text("value"), direction=F.col("direction")),
        part(limits, F.col("claim_id"), "limitation", short, category=F.col("category")),
        part(ahead, F.col("claim_id"), "future_work", short, category=F.col("category"), target=F.lit(None).cast("string")),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["node_id"])


def graph_edges(known: DataFrame, found: DataFrame, limits: DataFrame, ahead: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, paper_id, sentence_id, confidence) of all relation types that the records give."""
    paper = F.concat(F.lit("paper_"), F.col("paper_id").cast("string"))

    def part(rows: DataFrame, source: Column, target: Column, kind: Column | str, value: Column) -> DataFrame:
        return rows.select(source.alias("source_id"), target.alias("target_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("relation_type"), "paper_id", "sentence_id", value.alias("confidence"))

    composite = F.col("composite")
    role = F.when((F.col("entity_type") == "method") & (F.col("role") == "proposed"), "PROPOSED_BY").otherwise("USED_IN")
    own = known.where("entity_type = 'method' AND role = 'proposed'").select("paper_id", "sentence_id", F.col("entity_id").alias("m"))
    data = known.where("entity_type = 'dataset'").select("paper_id", F.col("entity_id").alias("other"))
    rivals = known.where("entity_type = 'method' AND role IN ('baseline', 'compared')").select("paper_id", F.col("entity_id").alias("other"))
    better = found.where("direction = 'improvement'").select("paper_id", "sentence_id", F.explode("methods").alias("m"), "baselines").select("paper_id", "sentence_id", "m", F.explode("baselines").alias("b"))
    return reduce(DataFrame.unionByName, [
        part(known.where("entity_type IN ('method', 'dataset')"), F.col("entity_id"), paper, role, composite),
        part(own.join(data, "paper_id"), F.col("m"), F.col("other"), "EVALUATED_ON", F.lit(0.90)),
        part(own.join(rivals, "paper_id").where("m <> other"), F.col("m"), F.col("other"), "COMPARED_WITH", F.lit(0.92)),
        part(found, F.col("claim_id"), paper, "REPORTED_IN", composite),
        part(better, F.col("m"), F.col("b"), "OUTPERFORMS", F.lit(0.95)),
        part(limits.select("*", F.explode("affected").alias("m")), F.col("m"), F.col("claim_id"), "LIMITED_BY", composite),
        part(ahead, paper, F.col("claim_id"), "FUTURE_DIRECTION", composite),
    ])
