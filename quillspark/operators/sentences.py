"""Texts to sentences with provenance, scores and candidate contexts."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import rules, text

PER_CATEGORY, FIRST, LEAST = 8, 3, 1.0


BLOCKS = "h[1-6]|p|li|td|th|dd|dt|blockquote|pre|figcaption|caption"
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK = rf"(?is)<(?:{BLOCKS})\b[^>]*>(.*?)</(?:{BLOCKS})\s*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_blocks(pages: DataFrame) -> DataFrame:
    """(paper_id, page, block_idx, raw_text): the text of headings, paragraphs, list items, cells and the like, in order.

    Scripts, styles and comments are no text; tags inside a block go, line breaks stay breaks."""
    found = F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(BLOCK), F.lit(1))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)<br\b[^>]*>", "\n"), "<[^>]*>", "")
    plain = lambda x: reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, bare(x))
    return pages.select(F.col("page_id").alias("paper_id"), F.lit(1).alias("page"), F.posexplode(F.transform(found, plain)).alias("block_idx", "raw_text"))


def sections(blocks: DataFrame) -> DataFrame:
    """(paper_id, page, block_idx, text, section): headings carried to the blocks below; 'Abstract' at first."""
    clean = blocks.select("paper_id", "page", "block_idx", text.clean_line_noise(F.col("raw_text")).alias("text")).where("text <> ''")
    order = Window.partitionBy("paper_id").orderBy("page", "block_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = clean.withColumn("heading", text.heading(F.col("text")))
    carried = named.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit("Abstract")))
    return carried.where("heading IS NULL").drop("heading")


def indexed(blocks: DataFrame) -> DataFrame:
    """(paper_id, seq, sentence_id, page, section, text): sentences numbered within their paper."""
    each = blocks.select("paper_id", "page", "block_idx", "section", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    seq = F.row_number().over(Window.partitionBy("paper_id").orderBy("page", "block_idx", "i"))
    return each.select("paper_id", seq.alias("seq"), F.concat(F.lit("S"), seq.cast("string")).alias("sentence_id"), "page", "section", F.col("sentence").alias("text"))


def whole_texts(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Each text as one block under 'Abstract'; also the fallback for papers without a readable file."""
    return docs.select(F.col(key).alias("paper_id"), F.lit(1).alias("page"), F.lit(0).alias("block_idx"), text.clean_line_noise(F.col(column)).alias("text"), F.lit("Abstract").alias("section"))


def with_fallback(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """Blocks of papers, and the abstracts of those without any."""
    missing = papers.join(blocks.select("paper_id").distinct(), "paper_id", "left_anti")
    return blocks.unionByName(whole_texts(missing, "paper_id", "abstract").select(*blocks.columns))


def scored(found: DataFrame, cues: dict[str, list[str]] | None = None) -> DataFrame:
    """(paper_id, seq, category, score) of every sentence and category; what all categories ask of a sentence is evaluated once."""
    found = found.select("paper_id", "seq", F.lower("text").alias("low"), "section").withColumns({"kind": rules.category_of(F.col("section")), "words": rules.words_in(F.col("low"))})
    pairs = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("category"), rules.relevance_of(F.col("low"), F.col("kind"), F.col("words"), c, cues).cast("double").alias("score")) for i, c in enumerate(V.CATEGORIES)))
    return found.select("paper_id", "seq", F.inline(pairs)).select("paper_id", "seq", "category", "score")


def top_per_category(found: DataFrame, k: int = PER_CATEGORY, cues: dict[str, list[str]] | None = None) -> DataFrame:
    """(paper_id, category, rank, seq, score): the k best of each category on its own."""
    order = Window.partitionBy("paper_id", "category").orderBy(F.desc("score"), "seq")
    return scored(found, cues).where(F.col("score") > LEAST).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("paper_id", "category", "rank", "seq", "score")


def context(found: DataFrame, k: int = PER_CATEGORY, cues: dict[str, list[str]] | None = None) -> DataFrame:
    """The same, but a sentence that an earlier choice took counts only among a category's first FIRST.

    Which sentences are taken depends on all categories before, so a paper is folded by itself: its rows follow each other in
    a task, in order, and what is remembered between two of them is the paper's choice so far."""
    names = V.CATEGORIES

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, chosen, seen = object(), None, 0, set()
        for part in parts:
            made = []
            for paper, at, seq, score in zip(*(c.to_pylist() for c in part.columns)):
                if paper != last:
                    last, place, seen = paper, None, set()
                if at != place:
                    place, chosen = at, 0
                if chosen < k and (seq not in seen or chosen < FIRST):
                    chosen += 1
                    seen.add(seq)
                    made.append((paper, names[at], chosen, seq, score))
            kinds = (part.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.float64())
            columns = zip(*made) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["paper_id", "category", "rank", "seq", "score"])

    kind = dict(found.dtypes)["paper_id"]
    place = (F.array_position(F.array(*map(F.lit, names)), F.col("category")) - 1).cast("int")
    rows = scored(found, cues).where(F.col("score") > LEAST).select("paper_id", place.alias("place"), "seq", "score")
    ordered = rows.repartition("paper_id").sortWithinPartitions("paper_id", "place", F.desc("score"), "seq")
    return ordered.mapInArrow(fold, f"paper_id {kind}, category string, rank int, seq int, score double")


def prompt_blocks(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """(paper_id, prompt): the chosen sentences under their categories, literature sources left out."""
    lines = chosen.where("category <> 'literature_sources'").join(found, ["paper_id", "seq"])
    line = F.format_string("[%s] (p.%d, %s): %s", "sentence_id", "page", "section", "text")
    per = lines.groupBy("paper_id", "category").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    place = F.array_position(F.array(*map(F.lit, V.CATEGORIES)), F.col("category"))
    body = F.concat(F.lit("=== "), F.upper("category"), F.lit(" ===\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return per.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), body.alias("b")))), lambda x: x["b"]), "\n\n").alias("prompt"))
