"""Extraction by rules, conversion to entities and relations, validation of what was extracted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import rules
from ..functions.numbers import composite_confidence, percent

def rule_mentions(sentences: DataFrame, found: list[tuple], key: str = "paper_id") -> DataFrame:
    """(paper_id, canonical, ord, seq, section, quote): of each paper and canonical name the first sentence that a rule matches."""
    hits = F.filter(F.array(*(F.when(F.col("text").rlike("(?iU)" + r[0]), F.struct(F.lit(i).alias("ord"), F.lit(r[1]).alias("canonical"))) for i, r in enumerate(found))), lambda x: x.isNotNull())
    each = sentences.select(key, "seq", "section", "text", F.inline(hits))
    first = Window.partitionBy(key, "canonical").orderBy("seq", "ord")
    rows = each.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select(key, "canonical", "ord", "seq", "section", F.substring("text", 1, 120).alias("quote"))


def method_role(section: Column) -> Column:
    return F.when(section.isin("Abstract", "Methodology"), "proposed").otherwise("baseline")


def method_type(name: Column) -> Column:
    return F.when(F.lower(name).rlike("model|llm"), "model").otherwise("framework")


def modality(name: Column) -> Column:
    return F.when(F.lower(name).rlike("kdd|nsl"), "tabular").otherwise("multimodal")


def named_proposals(sentences: DataFrame, key: str = "paper_id") -> DataFrame:
    """(paper_id, seq, name): what a sentence says is proposed."""
    name = F.trim(F.regexp_extract("text", V.PROPOSAL, 1))
    return sentences.select(key, "seq", name.alias("name")).where("name <> ''")


def first_number(c: Column) -> Column:
    """The first number in a text; an integer's sign is not part of it."""
    return F.nullif(F.regexp_extract(c, V.NUMBER, 0), F.lit("")).try_cast("double")


def relations(methods: DataFrame, datasets: DataFrame) -> DataFrame:
    """(paper_id, method, dataset, shared, confidence): proposed methods evaluated on the datasets of their paper.

    methods and datasets: (paper_id, name, role, sentence_id)."""
    m = methods.where("role = 'proposed'").select("paper_id", F.col("name").alias("method"), F.col("sentence_id").alias("ms"))
    d = datasets.select("paper_id", F.col("name").alias("dataset"), F.col("sentence_id").alias("ds"))
    shared = F.col("ms") == F.col("ds")
    sure = F.when(shared, composite_confidence(F.lit(0.90), F.lit(0.88), F.lit(1.0), F.lit(0.85))).otherwise(composite_confidence(F.lit(0.75), F.lit(0.88), F.lit(0.80), F.lit(0.85)))
    return m.join(d, "paper_id").select("paper_id", "method", "dataset", shared.alias("shared"), sure.alias("confidence"))


def validated(entities: DataFrame) -> DataFrame:
    """entities(raw_name, entity_type, quote, composite, ...) with status, reason, adjusted confidence and rerouted type; the first rule that applies decides."""
    raw, low = F.trim("raw_name"), F.lower(F.trim("raw_name"))
    clean = F.trim(F.regexp_replace(low, r"(?U)[^\w\s-]", ""))
    quote = F.lower(F.coalesce("quote", F.lit("")))
    tokens = F.filter(F.split(clean, r"(?U)[\s\-_]+"), lambda t: F.length(t) > 2)
    grounded = F.size(F.filter(tokens, lambda t: F.contains(quote, t)))
    index = clean.isin(V.LITERATURE_INDEXES) | rules.contains_any(clean, V.LITERATURE_INDEXES)
    signs = rules.contains_any(low, V.DATASET_SIGNS) | rules.contains_any(quote, V.DATASET_SIGNS)
    dataset = F.col("entity_type") == "dataset"
    cases = [
        (rules.matches_any(raw, V.NUMERIC), "REJECTED", "number", F.lit(0.0), None),
        (clean.isin(V.FUNCTION_WORDS), "REJECTED", "function_word", F.lit(0.0), None),
        (F.length(clean) <= 2, "REJECTED", "short", F.lit(0.0), None),
        (raw.rlike(V.PERSON) & ~rules.contains_any(low, V.METHOD_SIGNS) & ~rules.contains_any(low, V.DATASET_SIGNS), "REJECTED", "person", F.lit(0.0), None),
        (index & dataset & (rules.contains_any(quote, V.SEARCH_SIGNS) | clean.isin(V.LITERATURE_INDEXES)), "ACCEPTED", "rerouted", F.lit(0.98), "literature_source"),
        ((F.size(tokens) > 0) & (grounded / F.size(tokens) < 0.5), "REJECTED", "not_grounded", F.lit(0.1), None),
        (dataset & ~signs & (F.size(F.split(clean, r"(?U)\s+")) > 5), "FLAGGED", "no_signal", F.lit(0.65), None),
        (F.lit(True), "ACCEPTED", "passed", F.col("composite"), None),
    ]
    made = F.when(F.lit(False), F.struct(F.lit("").alias("status"), F.lit("").alias("reason"), F.lit(0.0).alias("adjusted"), F.lit(None).cast("string").alias("rerouted")))
    for test, status, reason, value, route in cases:
        made = made.when(test, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), value.cast("double").alias("adjusted"), F.lit(route).cast("string").alias("rerouted")))
    return entities.withColumn("v", made).select("*", "v.status", "v.reason", "v.adjusted", "v.rerouted").drop("v")


def cascade(items: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of items of which every key column names an accepted id."""
    for key in keys:
        items = items.join(accepted.select(F.col("id").alias(key)).distinct(), key, "left_semi")
    return items


def validation_report(checked: DataFrame) -> DataFrame:
    """(total, accepted, rejected, flagged, acceptance_rate, rejection_rate), rates 0 of nothing."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    made = checked.agg(F.count(F.lit(1)).alias("total"), n("ACCEPTED").alias("accepted"), n("REJECTED").alias("rejected"), n("FLAGGED").alias("flagged"))
    rate = lambda c: percent(F.col(c), F.col("total")) / 100
    return made.select("*", rate("accepted").alias("acceptance_rate"), rate("rejected").alias("rejection_rate"))


def rejection_reasons(checked: DataFrame) -> DataFrame:
    return checked.where("status = 'REJECTED'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
