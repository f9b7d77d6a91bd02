"""Hard-negative mining with a pivot table.

Every vector x gets one component more, sqrt(M^2 - |x|^2) for the largest norm M of
all, an anchor q a zero: then |x' - q'|^2 = M^2 + |q|^2 - 2 q.x, and the order by
inner product is the reverse order by Euclidean distance. A few pivots (far from
each other, chosen on a bounded sample: they steer the pruning only, never the
result) and the distances of all rows to them make the pivot table, which is
written once. For an anchor and a row, the triangle inequality over the pivots
brackets their distance, hence their score, from the stored distances alone; rows
whose bracket can't matter go, the survivors are scored exactly.

Two passes over a grid of blocks, as in the search for the best k: the first finds
each anchor's positives (best rows of its label: the k-th largest lower bound is a
threshold for upper bounds), the second the negatives, for which a positive's score
sets a band. Blocks hold rows of like distances to the first pivots, so whole blocks
fall out of a band where vectors form clusters. A block sends at most k rows for
an anchor, or for an anchor and positive, to the merge, which the engine prunes again before its shuffle.
No side is broadcast but the pivots (PIVOTS vectors); a label that holds most rows is
spread over all blocks, as blocks don't follow labels.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part. Vectors of unequal length share the components that both
have (they are filled with zeros). Ties go to the smaller id. A row is never its own
anchor's positive or negative, nor is another row of the same id; rows that repeat
an id are candidates each, and anchors that repeat an id are mined each. Anchors
without positives, and positives without negatives, give no row. Other columns aren't read.
Scores are exact while norms stay below 2^26; beyond, sums are taken in 64-bit integers.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import attach, table
from .shared import scratch, stage
from .topk import quantised, sound

PIVOTS, SAMPLE = 12, 1024
NUMBERS, ROWS, ANCHORS = 2**18, 4096, 256
LANE_BLOCKS, GROUP_BLOCKS = 16, 4
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW, HIGH = 50, 95
SLACK, DENSE = 1e-6, 0.1
BLOCK = ("ids", "labels", "vectors", "squares", "distances")


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers, filled with zeros up to dim."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    made = np.zeros((len(sizes), dim), np.int64)
    made[np.arange(dim) < sizes[:, None]] = flat
    return made


def squares(vectors: np.ndarray) -> np.ndarray:
    real = vectors.astype(np.float64)
    return np.einsum("ij,ij->i", real, real)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while every partial sum is a whole number there."""
    if float(np.sqrt(squares(left).max(initial=0.0) * squares(right).max(initial=0.0))) < 2.0**52:
        return np.rint(left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def apart(vectors: np.ndarray, largest: float, count: int) -> np.ndarray:
    """Augmented rows of the sample, each the farthest from those before it; first the one farthest from their mean."""
    full = augmented(vectors, largest)
    near = ((full - full.mean(axis=0)) ** 2).sum(axis=1)
    chosen: list[int] = []
    for _ in range(min(count, len(full))):
        chosen.append(int(near.argmax()))
        far = ((full - full[chosen[-1]]) ** 2).sum(axis=1)
        near = far if len(chosen) == 1 else np.minimum(near, far)
    return full[chosen]


def augmented(vectors: np.ndarray, largest: float) -> np.ndarray:
    """x' of each row; largest is the square of the largest norm."""
    own = squares(vectors)
    return np.hstack([vectors.astype(np.float64), np.sqrt(np.maximum(largest - own, 0.0))[:, None]])


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, one column for each pivot."""
    found = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(found, 0.0))


def blocks(rows: DataFrame, dim: int, largest: float, pivots: np.ndarray, size: int) -> DataFrame:
    """(id, label, q) as rows of BLOCK, each up to so many vectors with their distances to the pivots, every column as bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                vectors = matrix(part.column(2), dim)
                found = to_pivots(augmented(vectors, largest), pivots)
                made = (part.column(0).to_numpy(), part.column(1).to_numpy(), vectors, squares(vectors), found)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in made], list(BLOCK))

    return rows.mapInArrow(kernel, ", ".join(f"{n} binary" for n in BLOCK))


def like(vector: Column, pivots: np.ndarray, pieces: int = 16) -> Column:
    """A rough place of a vector among the first two pivots, so that sorted rows make blocks of like distances."""
    def side(p: np.ndarray) -> Column:
        weights = F.array(*(F.lit(float(x)) for x in p[:-1]))
        return F.aggregate(F.zip_with(vector, weights, lambda x, w: F.coalesce(x * w, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    marks = [float((p * p).sum()) or 1.0 for p in pivots[:2]]
    return F.array(*(F.floor(side(p) / m * pieces) for p, m in zip(pivots[:2], marks)))


class Cell:
    """The rows of a block and what the pivot table says of their scores with an anchor; distances have a row for each pivot."""

    def __init__(self, parts: dict[str, np.ndarray], dim: int, largest: float) -> None:
        self.ids, self.labels = parts["ids"], parts["labels"]
        self.vectors = parts["vectors"].reshape(len(self.ids), dim)
        self.distances = np.ascontiguousarray(parts["distances"].reshape(len(self.ids), -1).T)
        self.low, self.high = self.distances.min(axis=1), self.distances.max(axis=1)
        self.largest = largest
        self.own = {int(y): np.flatnonzero(self.labels == y) for y in np.unique(self.labels)}
        self.near = {y: self.distances[:, rows] for y, rows in self.own.items()}

    def scores(self, square: float, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score for distances between nearest and farthest; a little wider, as distances are rounded."""
        whole = self.largest + square
        slack = SLACK * (whole + 1) + 1e-6
        return (whole - farthest * farthest) / 2 - slack, (whole - nearest * nearest) / 2 + slack

    def bounds(self, square: float, own: np.ndarray, distances: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of each row (or of those with these distances): the triangle inequality over all pivots."""
        stored = self.distances if distances is None else distances
        nearest = np.abs(stored - own[:, None]).max(axis=0)
        farthest = (stored + own[:, None]).min(axis=0)
        return self.scores(square, nearest, farthest)

    def outer(self, square: float, own: np.ndarray) -> tuple[float, float]:
        """The same for all rows of the block together, from the least and greatest distances alone."""
        nearest = np.maximum(np.maximum(own - self.high, self.low - own), 0.0).max()
        farthest = (self.high + own).min()
        least, most = self.scores(square, np.array(nearest), np.array(farthest))
        return float(least), float(most)

    def exact(self, anchors: np.ndarray, survivors: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores) of what survived; one product for all where many did, as that costs less than to gather rows."""
        if sum(map(len, survivors.values())) > DENSE * len(survivors) * len(self.ids):
            every = products(anchors[list(survivors)], self.vectors)
            for n, (a, rows) in enumerate(survivors.items()):
                yield a, rows, every[n, rows]
        else:
            for a, rows in survivors.items():
                yield a, rows, products(self.vectors[rows], anchors[a : a + 1])[:, 0]


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    if len(scores) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return kept[np.lexsort((ids[kept], -scores[kept]))][:k]
    return np.lexsort((ids, -scores))


def of_label(cell: Cell, anchors: np.ndarray, anchor_ids: np.ndarray, labels: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): the k best of its label in the block."""
    norms, left = squares(anchors), {}
    for a in range(len(anchors)):
        if (rows := cell.own.get(int(labels[a]))) is None:
            continue
        others = cell.ids[rows] != anchor_ids[a]
        if others.sum() > k:
            least, most = cell.bounds(norms[a], own[a], cell.near[int(labels[a])])
            least = np.where(others, least, -np.inf)
            others &= most >= np.partition(least, len(least) - k)[len(least) - k]
        if others.any():
            left[a] = rows[others]
    for a, rows, found in cell.exact(anchors, left):
        best = first(found, cell.ids[rows], k)
        yield a, rows[best], found[best]


def in_bands(cell: Cell, anchors: np.ndarray, anchor_ids: np.ndarray, labels: np.ndarray, own: np.ndarray, bands: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, band, rows, scores): the k best of other labels between each band's ends; bands (anchor, band, 2), empty ones upside down."""
    norms, left = squares(anchors), {}
    used = bands[:, :, 0] <= bands[:, :, 1]
    for a in np.flatnonzero(used.any(axis=1)).tolist():
        low, high = bands[a, used[a], 0].min(), bands[a, used[a], 1].max()
        least, most = cell.outer(norms[a], own[a])
        if most < low or least > high:
            continue
        least, most = cell.bounds(norms[a], own[a])
        rows = np.flatnonzero((most >= low) & (least <= high) & (cell.labels != labels[a]) & (cell.ids != anchor_ids[a]))
        if len(rows):
            left[a] = rows
    for a, rows, found in cell.exact(anchors, left):
        for n in np.flatnonzero(used[a]):
            fit = np.flatnonzero((found >= bands[a, n, 0]) & (found <= bands[a, n, 1]))
            if len(fit):
                best = fit[first(found[fit], cell.ids[rows[fit]], k)]
                yield a, int(n), rows[best], found[best]


def meet(anchors: DataFrame, candidates: DataFrame, lanes: int, groups: int) -> DataFrame:
    """Each block of anchors beside each block of candidates: a grid, whose cells many tasks share."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    mine = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns), place("query", lanes).alias("lane"), every(groups).alias("group"))
    there = candidates.select("*", place("ids", groups).alias("group"), every(lanes).alias("lane"))
    return there.join(mine.hint("shuffle_hash"), ["lane", "group"]).drop("lane", "group")


KINDS = {"ids": np.int64, "labels": np.int64, "vectors": np.int64, "squares": np.float64, "distances": np.float64, "query": np.int64, "scores": np.int64}


def arrays(b: pa.RecordBatch, row: int, prefix: str = "") -> dict[str, np.ndarray]:
    """The arrays of a block; only columns of that prefix."""
    names = [n for n in b.schema.names if n.startswith("a_") == bool(prefix)]
    return {n.removeprefix(prefix): np.frombuffer(b.column(n)[row].as_buffer(), KINDS[n.removeprefix(prefix)]) for n in names}


def asked(rows: DataFrame, dim: int, pivots: np.ndarray, size: int, wanted: int) -> DataFrame:
    """Anchors (query, id, label, q, scores: those of its positives) as blocks with their own distances to the pivots."""
    names = ["query", "ids", "labels", "vectors", "distances", "scores"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                vectors = matrix(part.column(3), dim)
                points = np.hstack([vectors.astype(np.float64), np.zeros((len(vectors), 1))])
                known = matrix(part.column(4), wanted)
                known[np.arange(wanted) >= part.column(4).value_lengths().to_numpy(zero_copy_only=False)[:, None]] = -1
                made = (part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), vectors, to_pivots(points, pivots), known)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in made], names)

    return rows.mapInArrow(kernel, ", ".join(f"{n} binary" for n in names))


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors are (vec_id long, label long, q array<long>); low and high are percent of the positive's score."""
    rows = stage(rows.select("vec_id", "label", "q"), "vectors")
    with scratch() as keep:
        own = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        facts = rows.agg(F.max(F.size("q")), F.max(own), F.count(F.lit(1))).first()
        dim, largest, total = max(facts[0] or 1, 1), float(facts[1] or 0.0), facts[2]
        sample = rows.orderBy(F.xxhash64("vec_id", "q"), "vec_id", "q").limit(SAMPLE).select("q").toArrow()["q"].combine_chunks()
        pivots = apart(matrix(sample, dim), largest, PIVOTS) if len(sample) else np.zeros((1, dim + 1))
        size = max(1, min(ROWS, NUMBERS // dim))
        few = max(1, min(ANCHORS, size))
        sorted_rows = rows.select("vec_id", "label", "q", like(F.col("q"), pivots).alias("near")).repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id")
        pivot_table = stage(blocks(sorted_rows.select("vec_id", "label", "q"), dim, largest, pivots, size), "pivot-table")
        numbered = stage(anchors.select(F.monotonically_increasing_id().alias("query"), "vec_id", "label", "q"), "anchors")
        lanes = max(1, -(-numbered.count() // (few * LANE_BLOCKS)))
        groups = max(1, -(-total // (size * GROUP_BLOCKS)))

        def best_of_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    cell, ask = Cell(arrays(b, row), dim, largest), arrays(b, row, "a_")
                    n = len(ask["ids"])
                    met = list(of_label(cell, ask["vectors"].reshape(n, dim), ask["ids"], ask["labels"], ask["distances"].reshape(n, -1), positives))
                    if met:
                        sizes = [len(r) for _, r, _ in met]
                        at = np.repeat([a for a, _, _ in met], sizes)
                        found = np.concatenate([r for _, r, _ in met])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ask["query"][at]), pa.array(cell.ids[found]), pa.array(np.concatenate([s for _, _, s in met]))], ["query", "positive_id", "positive_score"])

        blank = F.array().cast("array<long>")
        plain = asked(numbered.select("query", "vec_id", "label", "q", blank), dim, pivots, few, positives)
        found = meet(plain, pivot_table, lanes, groups).mapInArrow(best_of_label, "query long, positive_id long, positive_score long")
        order = Window.partitionBy("query").orderBy(F.desc("positive_score"), "positive_id")
        chosen = stage(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
        lists = chosen.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
        known = numbered.join(lists, "query").select("query", "vec_id", "label", "q", "scores")

        def best_in_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    cell, ask = Cell(arrays(b, row), dim, largest), arrays(b, row, "a_")
                    n = len(ask["ids"])
                    scores = ask["scores"].reshape(n, positives)
                    # ends of each band as whole scores; a score below 0, like no score, has none
                    bands = np.stack([-(-low * scores // 100), high * scores // 100], axis=2)
                    bands[scores < 0] = (1, 0)
                    met = list(in_bands(cell, ask["vectors"].reshape(n, dim), ask["ids"], ask["labels"], ask["distances"].reshape(n, -1), bands, negatives))
                    if met:
                        sizes = [len(r) for _, _, r, _ in met]
                        at, place = np.repeat([a for a, _, _, _ in met], sizes), np.repeat([p for _, p, _, _ in met], sizes)
                        found = np.concatenate([r for _, _, r, _ in met])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ask["query"][at]), pa.array((place + 1).astype(np.int32)), pa.array(cell.ids[found]), pa.array(np.concatenate([s for *_, s in met]))],
                            ["query", "place", "negative_id", "negative_score"])

        mined = meet(asked(known, dim, pivots, few, positives), pivot_table, lanes, groups).mapInArrow(best_in_bands, "query long, place int, negative_id long, negative_score long")
        order = Window.partitionBy("query", "place").orderBy(F.desc("negative_score"), "negative_id")
        ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        names = numbered.select("query", F.col("vec_id").alias("anchor_id"))
        return keep(ranked.join(chosen, ["query", "place"]).join(names, "query").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the embeddings whose id is divisible by 50; labels of ids divisible by 7 are moved on by one."""
    attach(spark)
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("embedding")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), quantised(F.col("embedding"), SCALE).alias("q"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = {
    "op12_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
QUERIES = {"op12_negatives": op12_negatives}
