"""Text functions as column expressions: titles, identifiers, noise, sentences, headings, query plans.

Python's \\w, \\s and \\b know Unicode, so patterns on free text carry (?U).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import ABBREVIATIONS, HEADER, QUERY_STOP_WORDS

SHORTEST = 15
GUARD = "\x01"


def small(c: Column) -> Column:
    """Lower case letter by letter: a letter stays one, wherever it stands."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


#: Letters with an iota below, whose capital in Spark is two letters, and the one letter that it is elsewhere.
IOTA = "".join(map(chr, [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3]))
IOTA_CAPITAL = "".join(map(chr, [*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC]))


def capital(c: Column) -> Column:
    """Upper case of one letter; what has no capital of one letter stays as it is, but for ß."""
    return F.when(c == "ß", "Ss").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, IOTA, IOTA_CAPITAL))


def py_title(c: Column) -> Column:
    """Each run of letters with a capital first letter, the rest small."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(capital(F.substring(x, 1, 1)), small(F.substr(x, F.lit(2))))), "")


def clean_title(c: Column) -> Column:
    return small(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def author_token(c: Column) -> Column:
    """The family name of 'Last, First' or 'First Last', letters and digits only."""
    words = F.split(F.trim(c), r"(?U)\s+")
    return clean_title(F.when(F.contains(c, F.lit(",")), F.substring_index(c, ",", 1)).otherwise(F.element_at(words, -1)))


def doi(c: Column) -> Column:
    steps = (r"^https://doi\.org/", r"^http://doi\.org/", r"^doi:")
    found = reduce(lambda x, p: F.regexp_replace(x, p, ""), steps, F.trim(F.lower(c)))
    return F.nullif(F.trim(found), F.lit(""))


def arxiv_id(c: Column) -> Column:
    """From an abs or pdf address, or the whole string; versions stay."""
    number = r"\d{4}\.\d{4,5}(?:v\d+)?"
    linked = F.regexp_extract(c, rf"(?:abs|pdf)/({number})", 1)
    return F.when(linked != "", linked).when(F.trim(c).rlike(rf"^{number}$"), F.trim(c))


def clean_line_noise(c: Column) -> Column:
    """Joins words broken at a line's end, collapses white space, blanks a lone number."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"(?U)\s+", " "), r"(?U)^\d+\s*$", ""))


def abbreviation_steps() -> list[tuple[str, str]]:
    """(pattern, guarded form) of each abbreviation: its stops cannot end a sentence."""
    return [(a.replace(".", r"\.") + r"\s*", a.replace(".", GUARD) + " ") for a in ABBREVIATIONS]


def sentences(c: Column) -> Column:
    """The sentences of a text, of SHORTEST letters or more."""
    guarded = reduce(lambda x, s: F.regexp_replace(x, r"(?iU)\b" + s[0], s[1]), abbreviation_steps(), F.coalesce(c, F.lit("")))
    parts = F.split(guarded, r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.translate(F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), GUARD, ".")), lambda s: F.length(s) >= SHORTEST)


def heading(c: Column) -> Column:
    """The heading that a block is, or null."""
    found = F.regexp_extract(c, HEADER, 1)
    return F.when((found != "") & (F.size(F.split(F.trim(c), r"\s+")) <= 6), F.trim(found))


def grouped(words: Column) -> Column:
    """struct(word, at) for each different word of an array in order of words: the places (from 0) where it stands.

    Sorted pairs, cut where the word changes: no row leaves its task, and long texts cost n log n."""
    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | ~F.get(s, i)["w"].eqNullSafe(F.get(s, i - 1)["w"]))
        entry = lambda b, j: lambda a: F.struct(F.get(s, a)["w"].alias("word"), F.transform(F.slice(s, a + 1, b - a), lambda x: x["i"]).alias("at"))
        made = lambda b: F.transform(F.slice(b, 1, F.size(b) - 1), lambda a, j: entry(F.get(b, j + 1), j)(a))
        return F.transform(F.array(starts), made)[0]

    return F.when(F.size(words) > 0, F.transform(F.array(pairs), cut)[0])


def inverted_index_text(index: Column) -> Column:
    """A map of word -> positions back to text, by (position, word)."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def query_strategies(c: Column, most: int = 5) -> Column:
    """Search strategies of a free-text query, best first."""
    normal = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    useful = lambda words: F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(QUERY_STOP_WORDS))
    words = useful(F.split(normal, "[^a-zA-Z0-9]"))
    empty = F.array().cast("array<string>")
    joined = lambda a: F.array_join(a, " ")
    whole = F.when(F.size(words) > 0, F.array(joined(words))).otherwise(empty)

    def halves(word: str) -> Column:
        parts = F.split(normal, f" {word} ", -1)
        a, b = F.trim(parts[0]), F.trim(parts[1])
        x, y = useful(F.split(a, r"(?U)\s+")), useful(F.split(b, r"(?U)\s+"))
        short = F.when((F.size(x) > 0) & (F.size(y) > 0), F.array(F.concat_ws(" ", F.element_at(x, -1), F.element_at(y, 1)))).otherwise(empty)
        return F.concat(F.array(F.concat_ws(" ", a, b)), short)

    split = reduce(
        lambda rest, w: F.when(F.contains(F.lower(normal), F.lit(f" {w} ")) & F.contains(normal, F.lit(f" {w} ")), halves(w)).otherwise(rest),
        ["with", "using", "in", "for"], empty,
    )
    size = F.size(words)
    ends = F.when(size > 3, F.array(joined(F.slice(words, 1, 3)), joined(F.slice(words, F.greatest(size - 2, F.lit(1)), F.lit(3))))).otherwise(empty)
    unique = F.filter(F.array_distinct(F.transform(F.concat(whole, split, ends), lambda s: F.trim(s))), lambda s: s != "")
    two = F.when(size >= 2, F.array(F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, -1)))).otherwise(empty)
    return F.slice(F.array_distinct(F.concat(unique, F.when(F.size(unique) < most, two).otherwise(empty))), 1, most)


def extractive_label(c: Column) -> Column:
    """A title's leading phrase."""
    bare = F.regexp_replace(c, r"^(?:A|An|The|Towards|On)[ \t\n\f\r]+", "")
    low = F.lower(bare)
    cut = F.when(F.contains(bare, F.lit(":")), F.substring_index(bare, ":", 1))
    for word in (" for ", " via ", " using "):
        cut = F.coalesce(cut, F.when(F.contains(low, F.lit(word)), F.substring_index(bare, word, 1)))
    return F.trim(F.coalesce(cut, F.substring(bare, 1, 45)))


def embedding_input(title: Column, abstract: Column, blank: bool = False) -> Column:
    """A title and its abstract; with blank also an abstract that is empty, else the title stands alone."""
    if blank:
        return F.concat(title, F.lit(". "), abstract)
    return F.when(F.coalesce(F.trim(abstract), F.lit("")) != "", F.concat_ws(". ", title, abstract)).otherwise(title)
