"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights: its terms are the dimensions where
it isn't 0. Candidates are laid out in blocks of postings (term -> rows and
weights); queries in blocks of sparse rows. For each pair of blocks and each
term, the queries' weights times the postings are scattered into a dense score
array; a partition selects the best of the block, and a ranked window merges the
blocks. Every query is scored against every row: the query set is stated, and
both sides come in blocks of bounded size. The blocks meet in a grid whose sides
follow the numbers of rows: a lane holds up to LANE_BLOCKS query blocks, a group
about GROUP_BLOCKS candidate blocks. A candidate is sent once to each lane, a query
once to each group; no side is broadcast and no group is unbounded.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, nor do null ids. Ties go to the smaller id. Rows that repeat an id
are candidates each, but never of a query of that id; query rows that repeat an id
have a list of k each. Empty vectors score 0 with everything; a query with fewer
candidates than k returns them all. Vectors of unequal length share the terms that
both have.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import attach, table
from .shared import stage

QUERY_ROWS, ROWS = 512, 4096
LANE_BLOCKS, GROUP_BLOCKS = 16, 4
SCALE, K, STEP = 1024, 10, 100
SPARSE = ("starts", "terms", "weights")


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def sound(vector: Column) -> Column:
    """Not null, every component a finite number."""
    fine = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def blocks(df: DataFrame, rows: int) -> DataFrame:
    """df (long columns, then q array<long>) as rows that hold up to so many sparse vectors each, every column as bytes."""
    names = [*df.columns[:-1], *SPARSE]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                vectors = part.column(part.num_columns - 1)
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                terms = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                used = flat != 0
                owner = np.repeat(np.arange(len(sizes)), sizes)[used]
                starts = np.searchsorted(owner, np.arange(len(sizes) + 1))
                own = [part.column(i).to_numpy() for i in range(part.num_columns - 1)]
                made = (*own, starts.astype(np.int64), terms[used].astype(np.int64), flat[used].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], names)

    return df.mapInArrow(kernel, ", ".join(f"{n} binary" for n in names))


def postings(starts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights)."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(terms, kind="stable")
    names, first = np.unique(terms[order], return_index=True)
    cut = [*first, len(order)]
    return {int(t): (rows[order[a:b]], weights[order[a:b]]) for t, a, b in zip(names, cut, cut[1:])}


def scores(queries: tuple, candidates: tuple) -> np.ndarray:
    """Dense scores of sparse rows (starts, terms, weights), one row for each query, summed term by term."""
    found = postings(*candidates)
    made = np.zeros((len(queries[0]) - 1, len(candidates[0]) - 1), np.int64)
    for term, (rows, mine) in postings(*queries).items():
        if (other := found.get(term)) is None:
            continue
        if len(rows) == len(made) and len(other[0]) == made.shape[1]:
            made += mine[:, None] * other[1]
        else:
            made[np.ix_(rows, other[0])] += mine[:, None] * other[1]
    return made


def best(made: np.ndarray, asked: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate column) of the k best of each row; ties to the smaller id, a query's own id left out."""
    order = np.argsort(ids, kind="stable")
    made, ids = made[:, order], ids[order]
    rows, columns = [], []
    for i, line in enumerate(made):
        allowed = np.flatnonzero(ids != asked[i])
        line = line[allowed]
        if len(line) > k:
            least = np.partition(line, len(line) - k)[len(line) - k]
            above, equal = np.flatnonzero(line > least), np.flatnonzero(line == least)
            chosen = np.concatenate([above, equal[: k - len(above)]])
        else:
            chosen = np.arange(len(line))
        rows.append(np.full(len(chosen), i))
        columns.append(order[allowed[chosen]])
    return np.concatenate(rows), np.concatenate(columns)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for queries and candidates of (vec_id, q array<long>)."""
    # numbered once, in storage: a row is a query of its own, even where its id repeats
    asked = stage(queries.select(F.monotonically_increasing_id().alias("query"), "vec_id", "q"), "queries")
    lanes = max(1, -(-asked.count() // (QUERY_ROWS * LANE_BLOCKS)))
    groups = max(1, -(-candidates.count() // (ROWS * GROUP_BLOCKS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    mine = blocks(asked.withColumnRenamed("vec_id", "query_id"), QUERY_ROWS).select(
        "query", "query_id", *(F.col(c).alias(f"q_{c}") for c in SPARSE), place("query", lanes).alias("lane"), every(groups).alias("group"))
    there = blocks(candidates, ROWS).select("vec_id", *SPARSE, place("vec_id", groups).alias("group"), every(lanes).alias("lane"))
    cells = there.join(mine.hint("shuffle_hash"), ["lane", "group"]).select("query", "query_id", *(f"q_{c}" for c in SPARSE), "vec_id", *SPARSE)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                query, own, *parts = (np.frombuffer(b.column(c)[row].as_buffer(), np.int64) for c in range(9))
                ids = parts[3]
                made = scores(parts[:3], parts[4:])
                i, j = best(made, own, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(own[i]), pa.array(ids[j]), pa.array(made[i, j])], ["query", "query_id", "vec_id", "score"])

    found = cells.mapInArrow(kernel, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for every vector whose id is divisible by 100."""
    attach(spark)
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("q"))
    return top_k(rows.where(F.col("vec_id") % STEP == 0), rows)


ORACLE_SQL = {
    "op8_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
QUERIES = {"op8_topk": op8_topk}
