"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

1. A text is its tokens (words; runs of one symbol, up to three) and pairs of
   neighbours, a repeated neighbour being marked as such, hashed into BUCKETS.
2. Passes count the buckets over every document (raw) and over every one labelled as
   good (target), whose ids are broadcast in parts of about PART_IDS: the first pass counts all rows and the first
   part, each further one the rows of its part alone. The counts are vectors of fixed length, summed before they
   are shuffled; no text is. The log ratio of the smoothed models is a table of fixed size.
3. A document's log weight is LENGTH times the mean log ratio of its n-grams, so a
   text weighs as if it had LENGTH of them: a sum over thousands would drown the draw.
4. k documents are drawn without replacement with probability by weight: each
   gets log weight + Gumbel noise (from a hash of its id, so a rerun agrees), and
   the k largest stay, found by histogram refinement without gathering rows. k is
   a parameter; unless given it is the number of good documents to expect: the
   share of good ones among labelled rows of about that weight, over all rows.

Defined results: null and empty texts have no n-gram and log weight 0; rows whose keys
equal the k-th stay with it (repeated rows stay or go together; rows without an id
share one noise); without a row labelled good both models agree, all weights are 0
and, without k, all documents stay; columns that clash with ours pass through.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, table
from .shared import borrowed, mapped, slices, stage, two

BUCKETS, SMOOTH, LENGTH = 1 << 16, 1.0, 64
PART_IDS = 500_000
BINS, FAR = 1024, 64
TOKENS = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+").findall


class Hashes(dict):
    """Token -> 64 bits; a run of one symbol counts as at most three, case is a mark of its own."""

    def __missing__(self, token: str) -> int:
        plain = token[:3] if not token[0].isalnum() else token.lower() + "\x01" * (len(token) > 2 and token.isupper())
        made = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"))
        if len(token) < 64:
            if len(self) >= 150_000:
                self.clear()
            self[token] = made
        return made


_hashes = Hashes()


def grams(text: str) -> np.ndarray:
    """Buckets of a text's tokens and pairs."""
    one = np.fromiter(map(_hashes.__getitem__, TOKENS(text)), np.uint64)
    if not len(one):
        return np.zeros(0, np.int64)
    left, right = one[:-1], one[1:]
    pair = np.where(left == right, np.uint64(0x9E3779B97F4A7C15), left * np.uint64(0xC2B2AE3D27D4EB4F) ^ (right + np.uint64(0x165667B19E3779F9)))
    every = np.concatenate([one, pair])
    every ^= every >> np.uint64(31)
    every *= np.uint64(0xBF58476D1CE4E5B9)
    return (every >> np.uint64(48)).astype(np.int64)


def models(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of target to raw for each bucket, from all documents."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    parts = max(1, -(-good.count() // PART_IDS))
    texts = two(docs, "doc_id", "text")

    def part(i: int) -> DataFrame:
        ids = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == i).withColumn("good", F.lit(1))
        rows = texts.join(F.broadcast(ids), "doc_id", "inner" if i else "left")
        return rows.select("text", "good", F.lit(i == 0).alias("raw")).mapInArrow(kernel, "slot long, n long")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        with borrowed(_hashes):
            for b in slices(batches, 64):
                texts, good, raw = (c.to_pylist() for c in b.columns)
                found = [grams(t) for t in texts]
                for kind, asked in ((0, raw), (1, good)):
                    if mine := [g for g, x in zip(found, asked) if x]:
                        sums[kind] += np.bincount(np.concatenate(mine), minlength=BUCKETS)
        for kind in (0, 1):
            used = np.flatnonzero(sums[kind])
            yield pa.RecordBatch.from_arrays([pa.array(used * 2 + kind), pa.array(sums[kind][used])], ["slot", "n"])

    got = reduce(DataFrame.union, map(part, range(parts))).groupBy("slot").agg(F.sum("n").alias("n")).collect()
    sums = np.full((2, BUCKETS), SMOOTH)
    for r in got:
        sums[r["slot"] % 2, r["slot"] // 2] += r["n"]
    if sums[1].sum() == BUCKETS * SMOOTH:
        return np.zeros(BUCKETS)
    return np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())


def weighed(docs: DataFrame, ratio: np.ndarray, name: str, text: str = "text") -> DataFrame:
    """docs with the number of each row's n-grams and its log weight in a new column, a struct."""
    facts = T.StructType([T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    at = docs.columns.index(text)

    def kernel(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        with borrowed(_hashes):
            for b in slices(batches):
                found = [grams(t or "") for t in b.column(at).to_pylist()]
                made = [pa.array([len(g) for g in found], pa.int64()), pa.array([LENGTH * float(ratio[g].mean()) if len(g) else 0.0 for g in found])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(made, ["n_grams", "log_weight"])], names)

    return mapped(docs, kernel, **{name: facts})


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """The k-th largest of the column key (minus infinity where there are at most k); narrows a histogram until a bin is small."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k >= n:
        return float("-inf")
    live, left = df.select(key), k
    while n > 50_000 and (width := (high - low) / BINS) > abs(high) * 1e-14:
        bin_of = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1)).cast("int")
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in live.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if left <= counts[b][0]:
                break
            left -= counts[b][0]
        live, (n, low, high) = live.where(bin_of == b), counts[b]
    if n > 50_000:  # rows of one key
        return low
    return live.orderBy(F.desc(key)).limit(left).agg(F.min(key)).first()[0]


def expected_good(rows: DataFrame, labels: DataFrame) -> int | None:
    """How many of rows (doc_id, log_weight) are good, by the labelled ones of about that weight; None without labels.

    Where no labelled row has that weight, documents of a weight of 1 or more count."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    placed = rows.select("doc_id", F.floor(F.greatest(F.least("log_weight", F.lit(float(FAR))), F.lit(float(-FAR)))).alias("b"))
    every = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = placed.join(known, "doc_id").groupBy("b").agg(F.avg((F.col("quality") == 1).cast("double")).alias("share")).collect()
    share = {r["b"]: r["share"] for r in seen}
    return round(sum(r["n"] * share.get(r["b"], float(r["b"] >= 0)) for r in every)) if share else None


def drawn(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 1, name: str = "draw", keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text and what else they have) with a new column, a struct of n_grams, log_weight, gumbel_key and kept."""
    ratio = models(docs, labels)
    rows = weighed(docs, ratio, name)
    rows = stage(rows if keep_text else rows.drop("text"), "weighed")
    doc, own = F.col("doc_id").cast("long"), F.col(f"`{name}`")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), doc), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    gumbel = own["log_weight"] - F.log(-F.log(uniform))
    keyed = rows.select(doc.alias("doc_id"), own["log_weight"].alias("log_weight"), gumbel.alias("gumbel_key"))
    if k is None:
        k = expected_good(keyed, labels) if ratio.any() else None
    last = float("-inf") if k is None else kth_largest(keyed, "gumbel_key", k) if k else float("inf")
    return rows.withColumn(name, F.struct(own["n_grams"].alias("n_grams"), own["log_weight"].alias("log_weight"), gumbel.alias("gumbel_key"), (gumbel >= last).alias("kept")))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 1) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, kept for every document."""
    return drawn(two(docs, "doc_id", "text"), labels, k, seed, keep_text=False).select("doc_id", "draw.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log weight, noisy key and whether the draw keeps it."""
    attach(spark)
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
