"""Sparse tf-idf vectors over the corpus's most frequent words, and diverse choice among them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import once
from .ranking import idf, tallied

FEATURES = 1000


def vocabulary(docs: DataFrame, size: int = FEATURES, stop: Sequence[str] = (), key: str = "id", text: str = "text", counts: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, word, tf) of words of the vocabulary, (word, term, df, n)): the words that occur most, of equal counts the first by name;
    term numbers them by name from 0.

    Counts are summed before the best are taken, which every task does for itself first: one row a word meets, never a document."""
    tf, df = counts or tallied(docs, list(stop), key, text)
    most = tf.groupBy("word").agg(F.sum("tf").alias("times")).orderBy(F.desc("times"), "word").limit(size).select("word")
    names = most.agg(F.array_sort(F.collect_list("word")).alias("names")).select(F.posexplode("names").alias("term", "word"))  # at most size words
    terms = F.broadcast(names.join(df, "word").select("word", "term", "df", "n"))
    return tf.join(F.broadcast(names.select("word")), "word"), terms


def sparse(docs: DataFrame, size: int = FEATURES, stop: Sequence[str] = (), key: str = "id", text: str = "text", counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, terms, weights): unit vectors of tf-idf over the vocabulary, terms in order; empty for documents with none of its words."""
    tf, terms = vocabulary(docs, size, stop, key, text, counts)
    rows = tf.join(terms, "word").select(key, F.struct("term", (F.col("tf") * idf()).alias("w")).alias("e"))
    made = rows.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("e"))  # at most size entries
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    vectors = made.select(key, F.transform("e", lambda x: x["term"]).alias("terms"), F.transform("e", lambda x: x["w"] / length).alias("weights"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return docs.select(key).join(vectors, key, "left").select(key, none("terms", "int"), none("weights", "double"))


def cosine(terms: Column, weights: Column, other_terms: Column, other_weights: Column) -> Column:
    """Cosine of two sparse unit vectors."""
    other = F.map_from_arrays(other_terms, other_weights)
    return F.aggregate(F.zip_with(terms, weights, lambda t, w: w * F.coalesce(F.try_element_at(other, t), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def dense(terms: Column, weights: Column, size: int = FEATURES) -> Column:
    """A sparse vector as an array of all its components."""
    known = F.map_from_arrays(terms, weights)
    return once(known, lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
