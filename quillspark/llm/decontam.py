"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's windows, one scan of each text.

Words are runs of letters a-z (A-Z lower-cased), digits and everything beyond
ASCII. They are found on UTF-8 bytes by one translation of bytes and a split; the
normalised text is " w1 w2 ... wn ". A pattern is a window of WORDS consecutive
words of an item (all its words, if fewer) between blanks, so a match starts and
ends at words. The automaton reports every window at every place in one pass,
whatever overlaps; its places are mapped back through the words' offsets, so spans
are code points of the original text. Each place ends at most one window of a
length, so a text costs its length times the number of lengths (WORDS at most).

Texts are never shuffled: the plan is one map over the documents, each task of which
builds the automaton from the broadcast windows. Their bytes are summed first: one
automaton holds SHARD bytes of patterns at most (it takes some 50 times as much
memory). A larger benchmark is dealt by hash to shards of that size: each text is
scanned once by each shard's automaton, and words hit by several shards are united
by place, so nothing is lost or counted twice.

Defined results: a null or empty text has no words, no hits and no items, and the
digest of the empty string. An item without words has no window. Items of a null id
make words hit, but aren't counted or named. Repeated items and items of one id
count once; repeated documents are judged row by row. Very long texts are scanned
whole. Other columns, whatever their names, pass through spans() and aren't read by contaminated().
"""
from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, table
from .shared import borrowed, mapped, sized, stage, two, unused

WORDS, SHARD, AT_ONCE = 10, 6_000_000, 8_000_000
# each byte of UTF-8 as it stands in normalised text: blank unless part of a word
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """The text's bytes with each that is part of no word as a blank: as long as the text in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


def windows(words: list[bytes], size: int = WORDS) -> set[bytes]:
    """The item's windows; one of all words if it has fewer."""
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def patterns(benchmark: DataFrame, key: str, text: str, size: int = WORDS) -> DataFrame:
    """(pattern, items): each distinct window with the sorted ids of its items as strings."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, 1, AT_ONCE):
            ids, found = [], []
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = windows(folded(body).split(), size)
                found.extend(own)
                ids.extend([name] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "pattern"])

    items = benchmark.select(F.col(key).cast("string").alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = items.mapInArrow(kernel, "item string, pattern binary")
    return made.groupBy("pattern").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Scanner:
    """The automaton of some windows; found() gives the hit words of a text and the items that hit them."""

    def __init__(self, found: list[tuple[bytes, list[str]]]) -> None:
        self.machine = ahocorasick.Automaton()
        for pattern, items in found:
            self.machine.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, len(pattern) + 2, items))
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def found(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(first word, words) of each match, and the items' ids. Bytes are scanned as characters, so places are those of bytes."""
        if self.empty or not words:
            return np.empty((0, 2), np.int64), set()
        line = f" {b' '.join(words).decode('latin-1')} "
        ends, facts = [], []
        for end, fact in self.machine.iter(line):
            ends.append(end - fact[1] + 1)
            facts.append(fact)
        if not ends:
            return np.empty((0, 2), np.int64), set()
        starts = np.cumsum([1, *(len(w) + 1 for w in words)]) - 1
        first = np.searchsorted(starts, np.array(ends))
        return np.stack([first, np.array([f[0] for f in facts])], axis=1), {i for f in facts for i in f[2]}


def covered(matches: np.ndarray, words: int) -> np.ndarray:
    """Whether each word lies in some match."""
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, matches[:, 0], 1)
    np.add.at(step, matches[:, 0] + matches[:, 1], -1)
    return np.cumsum(step[:words]) > 0


def runs(hit: np.ndarray) -> np.ndarray:
    """(start, end) of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def in_text(text: str, line: bytes, spans: np.ndarray) -> list[dict[str, int]]:
    """Spans of words as code points of the text they come from."""
    if not len(spans):
        return []
    held = np.frombuffer(line, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8))).reshape(-1, 2)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(points[edge[a, 0]]), "end": int(points[edge[z - 1, 1]])} for a, z in spans]


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def scanned(df: DataFrame, text: str, held: Broadcast, name: str) -> DataFrame:
    """df with FOUND of each text by the automaton of the broadcast windows, built once in each task."""
    plain = f"c{df.columns.index(text)}"
    kind = pa.struct([
        ("n_words", pa.int64()), ("words", pa.list_(pa.list_(pa.int64()))),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
    ])

    def kernel(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        with borrowed():
            machine = Scanner(held.value)
            for b in sized(batches, names.index(plain), AT_ONCE):
                rows = []
                for body in b.column(names.index(plain)).to_pylist():
                    line = folded(body or "")
                    words = line.split()
                    matches, items = machine.found(words)
                    own = runs(covered(matches, len(words))) if len(matches) else matches
                    rows.append({"n_words": len(words), "words": own.tolist(), "spans": in_text(body or "", line, own), "items": sorted(items)})
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names)

    return mapped(df, kernel, **{name: FOUND})


def united(a: str, b: str) -> str:
    """SQL that merges sorted disjoint runs of words of two shards, which may overlap: an array of [start, end]."""
    folded_in = "CASE WHEN size(m) > 0 AND element_at(m, -1)[1] >= r[0] THEN concat(slice(m, 1, size(m) - 1), array(array(element_at(m, -1)[0], greatest(element_at(m, -1)[1], r[1])))) ELSE concat(m, array(r)) END"
    return f"aggregate(array_sort(concat({a}, {b})), CAST(array() AS ARRAY<ARRAY<BIGINT>>), (m, r) -> {folded_in})"


def spans(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text", name: str = "found", size: int = WORDS) -> DataFrame:
    """df with a struct column: n_words, words (runs of hit words), spans (the same as code points) and items (ids that occur, sorted)."""
    spark = df.sparkSession
    known = stage(patterns(benchmark, key, item_text, size), "windows")
    total = known.agg(F.sum(F.length("pattern") + 2)).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    made = df.withColumn(text, F.col(f"`{text}`").cast("string"))
    part = unused(df, "part")
    for n in range(shards):
        own = known.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == n) if shards > 1 else known
        held = spark.sparkContext.broadcast([(bytes(r["pattern"]), r["items"]) for r in own.toLocalIterator()])
        made = scanned(made, text, held, part if n else name)
        if n:
            a, b = f"`{name}`", f"`{part}`"
            merged = F.expr(f"""named_struct('n_words', {a}.n_words, 'words', {united(f'{a}.words', f'{b}.words')},
                'spans', {a}.spans, 'items', array_sort(array_union({a}.items, {b}.items)))""")
            made = stage(made.withColumn(name, merged).drop(part), "scanned")
    return made if shards == 1 else respanned(made, text, name)


def respanned(df: DataFrame, text: str, name: str) -> DataFrame:
    """df whose spans follow the united runs of words."""
    plain, column = df.columns.index(text), df.columns.index(name)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, plain, AT_ONCE):
            rows = b.column(column).to_pylist()
            for body, row in zip(b.column(plain).to_pylist(), rows):
                row["spans"] = in_text(body or "", folded(body or ""), np.array(row["words"], np.int64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(rows, x.type) if i == column else x for i, x in enumerate(b.columns)], b.schema.names)

    names = [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields)])
    return df.toDF(*names).mapInArrow(kernel, schema).toDF(*df.columns)


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    found = spans(two(df, key, text), benchmark)
    hit = F.aggregate("found.words", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    # a null text is an empty one here
    return found.select(
        "doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.words") > 0).alias("contaminated"))


def op11_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items of the benchmark."""
    attach(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op11_decontam": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM benchmark),
p AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM i WHERE len(w) > 0),
pattern AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS win FROM p),
sizes AS (SELECT DISTINCT n FROM pattern),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n),
seen AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS win FROM place),
met AS (SELECT s.doc_id, s.n, s.pos, item_id FROM seen s JOIN pattern p ON s.n = p.n AND s.win = p.win),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
QUERIES = {"op11_decontam": op11_decontam}
