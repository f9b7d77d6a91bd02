"""Ordered rules as column expressions: the first rule that matches decides, inside code generation."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import py_title


def first_match(c: Column, rules: list[tuple], field: int = 1, flags: str = "(?iU)") -> Column:
    """The field of the first rule whose pattern is found in c, or null."""
    made = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        made = made.when(c.rlike(flags + rule[0]), F.lit(rule[field]))
    return made


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns), F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words), F.lit(False))


def is_generic(c: Column) -> Column:
    """Whether a name is too generic, too short or a number."""
    bare = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9\s]", "")))
    return bare.isin(V.GENERIC_NOUNS + V.GENERIC_PAIRS) | (F.length(bare) < 3) | bare.rlike("^[0-9]+$")


def normalised(c: Column, rules: list[tuple]) -> Column:
    """Canonical name by rule; else without quotes, in title case if short; empty for generic names."""
    name = F.trim(c)
    bare = F.trim(F.regexp_replace(name, "^[\"`']+|[\"`']+$", ""))
    rest = F.when(F.length(bare) < 35, py_title(bare)).otherwise(bare)
    return F.when(is_generic(c), F.lit("")).otherwise(F.coalesce(first_match(name, rules), rest))


def section_rules() -> list[tuple[str, str]]:
    """One pattern for each category, from its list."""
    return [("|".join(f"(?:{p})" for p in patterns), name) for name, patterns in V.SECTIONS.items()]


def category_of(c: Column) -> Column:
    """The section category of a heading."""
    return F.coalesce(first_match(F.lower(F.trim(c)), section_rules(), flags="(?U)"), F.lit("other"))


def relevance(text: Column, section: Column, target: str, cues: dict[str, list[str]] | None = None) -> Column:
    """How relevant a sentence is to a category: its section, its cues, its length."""
    return relevance_of(F.lower(text), category_of(section), words_in(F.lower(text)), target, cues)


def words_in(low: Column) -> Column:
    return F.size(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != ""))


def relevance_of(low: Column, kind: Column, words: Column, target: str, cues: dict[str, list[str]] | None = None) -> Column:
    """relevance from what all categories need: the text in small letters, its section's category, its number of words."""
    bonus = F.when(kind == target, 3.0)
    if target in ("methods", "limitations"):
        bonus = bonus.when(kind == "abstract_intro", 1.5)
    found = [F.regexp_count(low, F.lit("(?U)" + p)) for p in (V.CUES if cues is None else cues).get(target, [])]
    return bonus.otherwise(0.0) + 2.0 * reduce(lambda a, b: a + b, found, F.lit(0)) - F.when((words < 6) | (words > 60), 1.0).otherwise(0.0)


def is_noise(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return matches_any(low, V.NOISE) | F.contains(low, F.lit("arxiv")) | (F.length(low) < 3)


def once(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def keywords_in(low: Column, words: list[str]) -> Column:
    """How many of the patterns occur; plain words are looked for as such, so that many of them make no long code."""
    plain = [w for w in words if re.fullmatch(r"[\w\s-]+", w)]
    found = F.size(F.filter(F.array(*map(F.lit, plain)), lambda w: F.contains(low, w))) if plain else F.lit(0)
    return reduce(lambda n, w: n + F.coalesce(low.rlike(w).cast("int"), F.lit(0)), [w for w in words if w not in plain], found)


def theme(c: Column, themes: list[tuple] | None = None) -> Column:
    """struct(theme_id, category): the theme with most keywords in the text, else by fallback words."""
    themes = V.THEMES if themes is None else themes
    pair = lambda a, b: F.struct(F.lit(a).alias("theme_id"), F.lit(b).alias("category"))

    def best(low: Column) -> Column:
        return F.array_max(F.array(*(F.struct(keywords_in(low, words).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("theme_id"), F.lit(cat).alias("category")) for i, (name, cat, words) in enumerate(themes))))

    def rest(low: Column) -> Column:
        cost, data = pair("theme_compute_scaling", "computational_cost"), pair("theme_data_annotation", "data_scarcity")
        return F.when(contains_any(low, V.COST_WORDS), cost).when(contains_any(low, V.DATA_WORDS), data).otherwise(pair("theme_general_empirical", "general"))

    def decided(low: Column) -> Column:
        return once(best(low), lambda b: F.when(b["score"] >= 1, F.struct(b["theme_id"].alias("theme_id"), b["category"].alias("category"))).otherwise(rest(low)))

    return once(F.lower(c), decided)
