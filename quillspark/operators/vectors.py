"""Vectors and clusters: norms, centroids, linear-time quality metrics, representatives, density clustering.

members(cluster_id, id, v array<double>), v of unit length; cluster -1 is noise. With S the
sum of a cluster's vectors, mean pairwise similarity is (|S|^2 - sum |x|^2) / (n (n - 1)) and the
mean cosine distance of x to another cluster 1 - x.S / n, so no metric looks at pairs of points.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp01
from ..session import written
from .columns import dot, unit
from .density import clusterings, density_labels
from .reduction import reduced


def norm_check(vectors: DataFrame, column: str = "v") -> DataFrame:
    """(n, dims, off_norm, broken): rows, distinct lengths, those off unit length by 1e-4, those with unusable components."""
    d = F.col(column).cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.size(d)).alias("dims"), F.count(F.when(F.abs(F.sqrt(dot(d, d)) - 1) > 1e-4, 1)).alias("off_norm"), F.count(F.when(bad, 1)).alias("broken"))


def sums(members: DataFrame) -> DataFrame:
    """(cluster_id, s, n, squares): the sum of each cluster's vectors, by dimension, so that a large cluster is summed in parts."""
    parts = members.select("cluster_id", F.posexplode("v").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"))  # one entry for each dimension
    facts = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum(dot(F.col("v"), F.col("v"))).alias("squares"))
    return whole.join(facts, "cluster_id")


def centroids(members: DataFrame) -> DataFrame:
    """(cluster_id, n, c): normalised means."""
    return sums(members).select("cluster_id", "n", unit(F.col("s")).alias("c"))


def intra_similarity(members: DataFrame) -> DataFrame:
    """(cluster_id, n, intra): mean pairwise similarity, 1 for a single member."""
    s = sums(members)
    n = F.col("n")
    return s.select("cluster_id", "n", F.when(n > 1, (dot(F.col("s"), F.col("s")) - F.col("squares")) / (n * (n - 1))).otherwise(1.0).alias("intra"))


def inter_similarity(members: DataFrame) -> DataFrame:
    """(a, b, similarity) of every two centroids; a row for each pair of clusters, which are few."""
    c = centroids(members).select("cluster_id", "c")
    return c.select(F.col("cluster_id").alias("a"), F.col("c").alias("x")).join(c.select(F.col("cluster_id").alias("b"), F.col("c").alias("y")), F.col("a") < F.col("b")).select("a", "b", dot(F.col("x"), F.col("y")).alias("similarity"))


def separation(members: DataFrame) -> DataFrame:
    return inter_similarity(members).agg(clamp01(1 - F.coalesce(F.avg("similarity"), F.lit(0.0))).alias("separation"))


def silhouette(members: DataFrame) -> DataFrame:
    """(id, cluster_id, a, b, silhouette) by cosine distance; 0 for a cluster of one.

    The clusters' sums stand in one array beside each row and are folded there: no row is made for a pair of row and cluster."""
    real = members.where("cluster_id >= 0")
    every = sums(real).agg(F.collect_list(F.struct("cluster_id", "s", "n")).alias("every"))  # an entry for each cluster
    near = lambda c: dot(F.col("v"), c["s"])
    own = F.filter("every", lambda c: c["cluster_id"] == F.col("cluster_id"))[0]
    others = F.filter("every", lambda c: c["cluster_id"] != F.col("cluster_id"))
    rows = real.join(F.broadcast(every)).select(
        "id", "cluster_id", (1 - (near(own) - dot(F.col("v"), F.col("v"))) / F.nullif(own["n"] - 1, F.lit(0))).alias("a"),
        F.array_min(F.transform(others, lambda c: 1 - near(c) / c["n"])).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return rows.withColumn("silhouette", F.coalesce(value, F.lit(0.0)))


def size_entropy(members: DataFrame) -> DataFrame:
    """(clusters, entropy): of cluster sizes, over that of equal ones."""
    n = members.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each cluster
    p = n.select((F.col("n") / total).alias("p"))
    made = p.agg(F.count(F.lit(1)).alias("clusters"), F.sum(-F.col("p") * F.log("p")).alias("h"))
    return made.select("clusters", F.when(F.col("clusters") > 1, F.col("h") / F.log(F.col("clusters").cast("double"))).otherwise(0.0).alias("entropy"))


def metrics(members: DataFrame) -> DataFrame:
    """One row: clusters, noise, largest, smallest, silhouette, intra, inter, entropy, score."""
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("cluster_id") >= 0
    one = size.agg(F.count(F.when(real, 1)).alias("clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("noise"), F.sum("n").alias("total"), F.max(F.when(real, F.col("n"))).alias("largest"), F.min(F.when(real, F.col("n"))).alias("smallest"))
    some = members.where("cluster_id >= 0")
    one = one.join(silhouette(members).agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette")))
    one = one.join(intra_similarity(some).agg(F.coalesce(F.avg("intra"), F.lit(0.0)).alias("intra"))).join(inter_similarity(some).agg(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("inter"))).join(size_entropy(members).select("entropy"))
    one = one.withColumns({"noise_share": F.col("noise") / F.col("total"), "largest_share": F.col("largest") / F.col("total")})
    return one.withColumn("score", score())


def score() -> Column:
    """The composite score of a clustering, from its metrics."""
    c = F.col
    value = (
        F.greatest(c("silhouette"), F.lit(-0.5)) + 2.2 * (c("intra") - c("inter")) + 0.4 * c("entropy") + 0.15 * F.least(c("clusters"), F.lit(12))
        - F.greatest(F.lit(0.0), 1.5 * (c("largest_share") - 0.55)) - F.greatest(F.lit(0.0), 2.0 * (c("noise_share") - 0.30))
        - F.when(c("noise_share") > 0.5, 3.0 * (c("noise_share") - 0.5)).otherwise(0.0)
    )
    return F.when(c("clusters") > 0, value).otherwise(-999.0)


def choose(runs: DataFrame) -> DataFrame:
    """The best run that passes the gates, else the best: runs(clusters, smallest, noise_share, silhouette, intra, inter, score, ...)."""
    gate = F.expr("clusters >= 2 AND smallest >= 3 AND noise_share < 0.55 AND silhouette > 0.05 AND intra - inter > 0.08")
    return runs.withColumn("passed", F.coalesce(gate, F.lit(False))).orderBy(F.desc("passed"), F.desc("score"), *sorted(c for c in runs.columns if c in ("min_cluster_size", "min_samples", "method"))).limit(1)


def member_order(members: DataFrame) -> DataFrame:
    """(cluster_id, id, similarity, rank): members by similarity to their centroid."""
    c = centroids(members).select("cluster_id", "c")
    rows = members.join(F.broadcast(c), "cluster_id").select("cluster_id", "id", dot(F.col("v"), F.col("c")).alias("similarity"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "id")))


def representatives(members: DataFrame, central: int = 6, diverse: int = 2) -> DataFrame:
    """(cluster_id, id, kind): the nearest to the centroid and the furthest; all of a cluster no larger than both.

    Each end is a short ranking, which the engine cuts before its shuffle, so a large cluster isn't sorted in one task."""
    c = centroids(members).select("cluster_id", "n", "c")
    rows = members.join(F.broadcast(c), "cluster_id").select("cluster_id", "n", "id", dot(F.col("v"), F.col("c")).alias("similarity"))
    nearest = Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "id")
    furthest = Window.partitionBy("cluster_id").orderBy("similarity", F.desc("id"))
    near = rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= central + diverse)
    near = near.where((F.col("n") <= central + diverse) | (F.col("rank") <= central)).withColumn("kind", F.lit("central"))
    far = rows.where(F.col("n") > central + diverse).withColumn("rank", F.row_number().over(furthest)).where(F.col("rank") <= diverse).withColumn("kind", F.lit("diverse"))
    return near.unionByName(far).select("cluster_id", "id", "kind")


def confidence(cohesion: Column, separated: Column, agreement: Column, label: Column) -> Column:
    return clamp01(0.35 * cohesion + 0.25 * separated + 0.20 * agreement + 0.20 * label)


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """(ari) of two labelings (a, b), from their contingency table."""
    table = labels.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = table.agg(pairs("n").alias("ij"), F.sum("n").alias("total"))
    one = table.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ai"))
    two = table.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("bj"))
    every = F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("ai") * F.col("bj") / every
    top = (F.col("ai") + F.col("bj")) / 2
    return both.join(one).join(two).select(F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / (top - expected)).alias("ari"))


# Parameter tiers by number of papers: (largest n, cluster sizes, samples).
TIERS = [(29, (2, 3, 4, 5), (1, 2, 3)), (80, (3, 4, 5, 6, 8), (1, 2, 3, 4)), (250, (4, 5, 6, 8, 10, 12, 15), (2, 3, 4, 5, 6)), (None, (5, 8, 10, 12, 15, 20, 25, 30), (3, 5, 8, 10, 12))]


def param_grid(spark, n: int) -> DataFrame:
    """(method, min_cluster_size, min_samples): every setting of the tier of n, samples no larger than clusters."""
    sizes, samples = next((s, m) for top, s, m in TIERS if top is None or n <= top)
    rows = [(k, a, b) for k in ("eom", "leaf") for a in sizes for b in samples if b <= a]
    return spark.createDataFrame(rows, "method string, min_cluster_size int, min_samples int")


def numpy_metrics(x: np.ndarray, labels: np.ndarray) -> dict:
    """The metrics of a clustering of a driver-sized matrix of unit vectors, by the identities of this module."""
    names, sizes = np.unique(labels[labels >= 0], return_counts=True)
    k, n = len(names), len(labels)
    made = {"clusters": k, "noise": int((labels < 0).sum()), "largest": int(sizes.max(initial=0)), "smallest": int(sizes.min()) if k else 0, "silhouette": 0.0, "intra": 0.0, "inter": 0.0, "entropy": 0.0}
    if k:
        real, own = x[labels >= 0], np.searchsorted(names, labels[labels >= 0])
        total = np.stack([real[own == i].sum(axis=0) for i in range(k)])
        squares = np.bincount(own, (real * real).sum(axis=1), k)
        made["intra"] = float(np.where(sizes > 1, ((total * total).sum(axis=1) - squares) / np.maximum(sizes * (sizes - 1), 1), 1.0).mean())
        if k > 1:
            c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300)
            made["inter"] = float((c @ c.T)[np.triu_indices(k, 1)].mean())
            share = sizes / sizes.sum()
            made["entropy"] = float(-(share * np.log(share)).sum() / np.log(k))
            if len(real) > k:
                near, each = real @ total.T, np.arange(len(real))
                a = 1 - (near[each, own] - (real * real).sum(axis=1)) / np.maximum(sizes[own] - 1, 1)
                far = 1 - near / sizes
                far[each, own] = np.inf
                b = far.min(axis=1)
                top = np.maximum(a, b)
                made["silhouette"] = float(np.where((sizes[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).mean())
    noise, largest = made["noise"] / max(n, 1), made["largest"] / max(n, 1)
    value = max(made["silhouette"], -0.5) + 2.2 * (made["intra"] - made["inter"]) + 0.4 * made["entropy"] + 0.15 * min(k, 12)
    value -= max(0.0, 1.5 * (largest - 0.55)) + max(0.0, 2.0 * (noise - 0.30)) + (3.0 * (noise - 0.5) if noise > 0.5 else 0.0)
    return made | {"noise_share": noise, "largest_share": largest, "score": value if k else -999.0}


GRADED = "clusters int, noise int, largest int, smallest int, silhouette double, intra double, inter double, entropy double, noise_share double, largest_share double, score double"
SETTING = "method string, min_cluster_size int, min_samples int"


PART, SLICE, SHARE = 16_384, 50_000, 32_768  # most rows in a block, rows for a slice of clusters, clusters that a block meets at once
SUMS = "setting int, slice int, cluster binary, n binary, squares binary, s binary"


def labelled(found: DataFrame, unit_rows: DataFrame, settings: list[tuple[str, int, int]], n: int) -> DataFrame:
    """(block, labels, v): up to PART vectors as bytes with their clusters in all settings."""
    size, width = min(PART, max(2_048, n // 32)), len(settings)
    grid = found.sparkSession.createDataFrame([(*s, i) for i, s in enumerate(settings)], f"{SETTING}, setting int")
    each = found.join(F.broadcast(grid), ["method", "min_cluster_size", "min_samples"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("setting", "cluster_id")))["cluster_id"].alias("labels"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            made = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays(made, ["labels", "v"])

        for b in batches:
            labels, v = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            held.append((labels.reshape(-1, width).astype(np.int32), v.reshape(b.num_rows, -1)))
            if sum(len(h[0]) for h in held) >= size:
                yield packed()
        if held:
            yield packed()

    rows = each.join(unit_rows, "id").select("id", "labels", "v").repartition(-(-n // size), "id").select("labels", "v")
    return written(rows.mapInArrow(kernel, "labels binary, v binary").withColumn("block", F.monotonically_increasing_id()), "labelled")


def opened(labels: bytes, v: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(labels, np.int32).reshape(-1, width)
    return own, np.frombuffer(v, np.float64).reshape(len(own), -1)


def added(names: np.ndarray, n: np.ndarray, squares: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
    """Sums of rows of one cluster."""
    order = np.argsort(names, kind="stable")
    names, first = np.unique(names[order], return_index=True)
    return [names.astype(np.int32), *(np.add.reduceat(x[order], first, axis=0) for x in (n, squares, s))]


def cluster_sums(blocked: DataFrame, width: int, n: int) -> DataFrame:
    """SUMS: each setting's clusters in slices, with their sizes, sums of squares and summed vectors."""
    slices = -(-n // SLICE)
    kinds = (np.int32, np.int64, np.float64, np.float64)

    def out(setting: int, part: int, sums: list[np.ndarray]) -> list:
        return [setting, part, *(x.tobytes() for x in sums)]

    def table_of(rows: list[list]) -> list[pa.Array]:
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 4))]

    names = ["setting", "slice", "cluster", "n", "squares", "s"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own, x = opened(r["labels"], r["v"], width)
                squares = (x * x).sum(axis=1)
                for k in range(width):
                    for part in range(slices):
                        some = np.flatnonzero((own[:, k] >= 0) & (own[:, k] % slices == part))
                        if len(some):
                            sums = added(own[some, k], np.ones(len(some), np.int64), squares[some], x[some])
                            yield pa.RecordBatch.from_arrays(table_of([out(k, part, sums)]), names)

    def whole(part: pa.Table) -> pa.Table:
        parts = [[np.frombuffer(r[c], t) for c, t in zip(names[2:], kinds)] for r in part.to_pylist()]
        sums = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        sums[3] = sums[3].reshape(len(sums[0]), -1)
        return pa.table(table_of([out(part["setting"][0].as_py(), part["slice"][0].as_py(), added(*sums))]), names)

    made = blocked.select("labels", "v").mapInArrow(partial, SUMS).repartition(2 * slices * width, "setting", "slice")
    return written(made.groupBy("setting", "slice").applyInArrow(whole, SUMS), "sums")


def silhouettes(blocked: DataFrame, sums: DataFrame, width: int) -> DataFrame:
    """(setting, silhouette): means over the rows of clusters, as of silhouette(); every block meets SHARE clusters or a slice at once."""
    share, held, dealt = 0, 0, []
    sizes = sums.select("setting", "slice", (F.length("cluster") / 4).cast("int").alias("k")).orderBy("setting", "slice").collect()  # a row for each slice
    for r in sizes:
        if held and held + r["k"] > SHARE:
            share, held = share + 1, 0
        held += r["k"]
        dealt.append((r["setting"], r["slice"], share))
    spark = blocked.sparkSession
    shares = F.explode(F.sequence(F.lit(0), F.lit(share))).alias("share")
    left = blocked.select("block", "labels", "v", shares)
    right = sums.join(F.broadcast(spark.createDataFrame(dealt, "setting int, slice int, share int")), ["setting", "slice"]).join(F.broadcast(blocked.select(F.col("block").alias("to"))))
    kind = "block long, setting int, a binary, b binary"

    def meet(rows: pa.Table, clusters: pa.Table) -> pa.Table:
        out = []
        for r in rows.to_pylist():
            own, x = opened(r["labels"], r["v"], width)
            squares = (x * x).sum(axis=1)
            for c in clusters.to_pylist():
                some = np.flatnonzero(own[:, c["setting"]] >= 0)
                names, n = np.frombuffer(c["cluster"], np.int32), np.frombuffer(c["n"], np.int64)
                s, mine = np.frombuffer(c["s"], np.float64).reshape(len(n), -1), own[some, c["setting"]]
                a, b = np.full(len(some), np.nan), np.full(len(some), np.inf)
                for at in range(0, len(some), 1_024):
                    one = slice(at, at + 1_024)
                    near = x[some[one]] @ s.T
                    place = np.minimum(np.searchsorted(names, mine[one]), len(names) - 1)
                    here = np.flatnonzero((names[place] == mine[one]))
                    to = place[here]
                    more = here[n[to] > 1]
                    a[at + more] = 1 - (near[more, place[more]] - squares[some[one]][more]) / (n[place[more]] - 1)
                    far = 1 - near / n
                    far[here, to] = np.inf
                    b[one] = far.min(axis=1)
                out.append((r["block"], c["setting"], a.tobytes(), b.tobytes()))
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "setting", "a", "b"])

    def total(part: pa.Table) -> pa.Table:
        a, b = (np.stack([np.frombuffer(x, np.float64) for x in part[c].to_pylist()]) for c in ("a", "b"))
        a, b = np.fmax.reduce(a, axis=0), b.min(axis=0)
        top = np.maximum(a, b)
        fit = ~np.isnan(a) & np.isfinite(b) & (top != 0)
        value = np.where(fit, (b - a) / np.where(fit, top, 1), 0.0)
        return pa.table([part["setting"][:1], pa.array([value.sum()]), pa.array([len(value)])], ["setting", "total", "rows"])

    dealt_to = blocked.count() * (share + 1)
    met = left.repartition(dealt_to, "block", "share").groupBy("block", "share").cogroup(right.repartition(dealt_to, "to", "share").groupBy("to", "share")).applyInArrow(meet, kind)
    each = met.groupBy("block", "setting").applyInArrow(total, "setting int, total double, rows long")
    return each.groupBy("setting").agg((F.sum("total") / F.nullif(F.sum("rows"), F.lit(0))).alias("silhouette"))


def cluster_facts(sums: DataFrame) -> DataFrame:
    """(setting, clusters, rows, largest, smallest, intra, inter, entropy) from the sums of clusters; no two centroids meet, as their sum tells all."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, squares = np.frombuffer(r["n"], np.int64).astype(float), np.frombuffer(r["squares"], np.float64)
                s = np.frombuffer(r["s"], np.float64).reshape(len(n), -1)
                length = np.sqrt((s * s).sum(axis=1))
                intra = np.where(n > 1, (length**2 - squares) / np.maximum(n * (n - 1), 1), 1.0).sum()
                c = s[length > 0] / length[length > 0, None]
                facts = [len(n), int(n.sum()), int(n.max()), int(n.min()), intra, (n * np.log(n)).sum(), len(c), float((c * c).sum()), c.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array([r["setting"]], pa.int32()), *(pa.array([x]) for x in facts[:8]), pa.array([facts[8]], pa.list_(pa.float64()))], ["setting", "k", "rows", "largest", "smallest", "intra", "logs", "directed", "own", "c"])

    def whole(part: pa.Table) -> pa.Table:
        add = {c: float(np.sum(part[c].to_numpy())) for c in ("k", "rows", "intra", "logs", "directed", "own")}
        c = np.array(part["c"].to_pylist()).sum(axis=0)
        inter = (c @ c - add["own"]) / (add["directed"] * (add["directed"] - 1)) if add["directed"] > 1 else 0.0
        entropy = (np.log(add["rows"]) - add["logs"] / add["rows"]) / np.log(add["k"]) if add["k"] > 1 else 0.0
        made = [part["setting"][0].as_py(), int(add["k"]), int(add["rows"]), int(part["largest"].to_numpy().max()), int(part["smallest"].to_numpy().min()), add["intra"] / add["k"], float(inter), float(entropy)]
        return pa.table([pa.array([x], t) for x, t in zip(made, (pa.int32(), *[pa.int64()] * 4, *[pa.float64()] * 3))], ["setting", "clusters", "rows", "largest", "smallest", "intra", "inter", "entropy"])

    kind = "setting int, k long, rows long, largest long, smallest long, intra double, logs double, directed long, own double, c array<double>"
    return sums.mapInArrow(partial, kind).groupBy("setting").applyInArrow(whole, "setting int, clusters long, rows long, largest long, smallest long, intra double, inter double, entropy double")


def grades(found: DataFrame, unit_rows: DataFrame, settings: list[tuple[str, int, int]], n: int) -> DataFrame:
    """One row for each setting with what metrics() says of its clustering, from two passes over the vectors for all settings."""
    width = len(settings)
    blocked = labelled(found, unit_rows, settings, n)
    sums = cluster_sums(blocked, width, n)
    grid = F.broadcast(found.sparkSession.createDataFrame([(*s, i) for i, s in enumerate(settings)], f"{SETTING}, setting int"))
    one = cluster_facts(sums).join(silhouettes(blocked, sums, width), "setting", "left")
    one = grid.join(one, "setting", "left").fillna(0).withColumn("noise", F.lit(n) - F.col("rows"))
    one = one.withColumns({"noise_share": F.col("noise") / F.lit(n), "largest_share": F.col("largest") / F.lit(n)}).withColumn("score", score())
    return one.select("method", "min_cluster_size", "min_samples", *(F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in GRADED.split(", "))))


LARGEST = 5_000  # up to here a setting is one task over all vectors, beyond it many; the clusters are the same


def settings_of(vectors: DataFrame, n: int) -> list[tuple[str, int, int]]:
    return [tuple(r) for r in param_grid(vectors.sparkSession, n).collect()]


def graded(vectors: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(one row for each setting with its metrics, (method, min_cluster_size, min_samples, id, cluster_id) of all settings).

    Clusters are those of the reduced vectors, metrics those of the vectors themselves."""
    found = written(search(reduced(vectors, n), n), "clusterings")
    unit_rows = written(vectors.select("id", F.coalesce(unit(F.col("v")), F.col("v")).alias("v")), "unit")

    def facts(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        first, x = part.iloc[0], np.stack(part["v"].to_list())
        made = numpy_metrics(x, part["cluster_id"].to_numpy())
        return pd.DataFrame([{k: first[k] for k in ("method", "min_cluster_size", "min_samples")} | made])

    keys = ["method", "min_cluster_size", "min_samples"]
    if n <= LARGEST:
        return written(found.join(F.broadcast(unit_rows), "id").groupBy(*keys).applyInPandas(facts, f"{SETTING}, {GRADED}"), "graded"), found
    return written(grades(found, unit_rows, settings_of(vectors, n), n), "graded"), found


def with_setting(found: DataFrame, best: Row) -> DataFrame:
    """(id, cluster_id) of one setting."""
    own = (F.col("method") == best["method"]) & (F.col("min_cluster_size") == best["min_cluster_size"]) & (F.col("min_samples") == best["min_samples"])
    return found.where(own).select("id", "cluster_id")


def selected(vectors: DataFrame) -> DataFrame:
    """(id, cluster_id, pass): the clustering of the best setting (pass 1), and of its noise where that clusters well (pass 2).

    vectors(id, v), any number; labels stay in tables, the driver sees a row for each setting."""
    vectors = written(vectors.select("id", F.col("v").cast("array<double>").alias("v")), "vectors")
    n = vectors.count()
    if not n:
        return vectors.select("id", F.lit(-1).alias("cluster_id"), F.lit(1).alias("pass")).limit(0)
    runs, found = graded(vectors, n)
    one = with_setting(found, choose(runs).first()).withColumn("pass", F.lit(1))
    noise = written(vectors.join(one.where("cluster_id < 0").select("id"), "id"), "noise")
    rest = noise.count()
    if rest < 4:
        return one
    runs, found = graded(noise, rest)
    again = runs.where("clusters >= 2 AND smallest >= 2").orderBy(F.desc("score"), "method", "min_cluster_size", "min_samples").first()
    if again is None or again["silhouette"] < 0.15 or again["intra"] - again["inter"] <= 0.12 or again["smallest"] < 3:
        return one
    if stability(noise, rest, again["min_cluster_size"], again["min_samples"], method=again["method"]).agg(F.avg("ari")).first()[0] < 0.35:
        return one
    above = 1 + (one.agg(F.max("cluster_id")).first()[0])
    two = with_setting(found, again).where("cluster_id >= 0").select("id", (F.col("cluster_id") + above).alias("second"))
    both = one.join(two, "id", "left")
    return both.select("id", F.coalesce("second", "cluster_id").cast("int").alias("cluster_id"), F.when(F.col("second").isNotNull(), 2).otherwise(1).alias("pass"))


def search(vectors: DataFrame, n: int) -> DataFrame:
    """(method, min_cluster_size, min_samples, id, cluster_id) of every setting of the tier of n; -1 is noise."""
    if n > LARGEST:
        return clusterings(vectors, settings_of(vectors, n))
    rows = param_grid(vectors.sparkSession, n).join(F.broadcast(vectors.select("id", "v")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        first = part.iloc[0]
        labels = density_labels(np.stack(part["v"].to_list()), int(first["min_cluster_size"]), int(first["min_samples"]), first["method"])
        return part.assign(cluster_id=labels.astype("int32"))[["method", "min_cluster_size", "min_samples", "id", "cluster_id"]]

    return rows.groupBy("method", "min_cluster_size", "min_samples").applyInPandas(run, "method string, min_cluster_size int, min_samples int, id long, cluster_id int")


def stability(vectors: DataFrame, n: int, min_cluster_size: int, min_samples: int, seeds: int = 5, share: float = 0.85, method: str = "eom") -> DataFrame:
    """(seed, ari): agreement of clusterings of seeded subsamples with that of all vectors; 1 for fewer than ten.

    Up to LARGEST vectors a seed is one task; beyond, a seed's subsample has about that share of them, chosen by a hash of its ids."""
    spark = vectors.sparkSession
    if n > LARGEST:
        one = [(method, min_cluster_size, min_samples)]
        whole = written(clusterings(vectors, one).select("id", F.col("cluster_id").alias("a")), "whole")
        made = []
        for seed in range(seeds):
            some = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(share * 1_000_000))
            part = clusterings(some, one).select("id", F.col("cluster_id").alias("b"))
            made.append((seed, float(adjusted_rand(whole.join(part, "id").select("a", "b")).first()[0])))
        return spark.createDataFrame(made, "seed int, ari double")
    runs = spark.range(seeds).select(F.col("id").cast("int").alias("seed"))
    rows = runs.join(F.broadcast(vectors.select("id", "v")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        seed, x = int(part["seed"].iloc[0]), np.stack(part["v"].to_list())
        if len(x) < 10:
            return pd.DataFrame({"seed": [seed], "ari": [1.0]})
        some = np.sort(np.random.default_rng(seed).choice(len(x), math.ceil(share * len(x)), replace=False))
        a, b = density_labels(x, min_cluster_size, min_samples, method)[some], density_labels(x[some], min_cluster_size, min_samples, method)
        table = pd.crosstab(a, b).to_numpy().astype(float)
        two = lambda m: (m * (m - 1) / 2).sum()
        ij, ai, bj, every = two(table), two(table.sum(axis=1)), two(table.sum(axis=0)), len(a) * (len(a) - 1) / 2
        top, expected = (ai + bj) / 2, ai * bj / every
        return pd.DataFrame({"seed": [seed], "ari": [1.0 if top == expected else (ij - expected) / (top - expected)]})

    return rows.groupBy("seed").applyInPandas(run, "seed int, ari double")
