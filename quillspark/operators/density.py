"""Hierarchical density clusters of any number of vectors.

vectors(id long, v array<double>), all of one length. The steps, each a Spark job over
bounded pieces:

distinct   equal vectors are one with a number of copies; copies lie at its core distance from it
nearest    blocks of BLOCK rows meet in cells of GROUP blocks a side. One product of matrices gives all lengths of two
           blocks nearly; what may be among a row's nearest is measured exactly, and a cell sends the few nearest of each row
cored      core distances, from the nearest and their copies
spanning   mutual reachability is the greater of two core distances and the distance. An edge that leaves a component and
           is no longer than any that could be unknown there is surely in the spanning tree: rounds of least edges while
           there are many, one task for the last LOCAL
trees      the components that remain, without the largest, look once more among all vectors for their least edges, only
           with rows whose unknown edges may be shorter than those known; each search at least halves the components
condensed  the tree's edges in order of length, in bands of about BAND edges: a band's task knows
           only the sizes and clusters of the components that its edges join

Edges of equal length (there are many, as core distances repeat) are one step: all
that they join becomes one component at once, so no order among them matters. Distances come from one
function that sums dimension after dimension, so a pair has the same bits wherever it is
compared. The condensed tree (a row for each cluster, two for min_cluster_size points at most) is
what the driver sees; vectors, edges and labels stay in tables. The first search multiplies every block with every other, so
its work grows with the square of the different vectors, as every exact search here does; a level of equal lengths is never
split over bands. Vectors that hold nulls or no finite number are noise.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import groups

BLOCK, GROUP, SIDES = 1024, 16, 9  # a cell has GROUP blocks a side at most; SIDES as far as there are blocks, for enough tasks
MORE = 4  # edges that a row of a component brings back from a later search
LOCAL, BAND = 2_000_000, 2_000_000
TOP = 1e12  # the level of points at distance 0

Setting = tuple[str, int, int]  # method, min_cluster_size, min_samples


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    total, step = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for i in range(a.shape[1]):
        np.subtract(a[:, i, None], b[None, :, i], out=step)
        np.multiply(step, step, out=step)
        total += step
    return np.sqrt(total, out=total)


def prim(reach: np.ndarray) -> np.ndarray:
    """(weight, a, b) of the spanning tree of a dense matrix."""
    n = len(reach)
    best, source, inside = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    made, now = np.empty((max(n - 1, 0), 3)), 0
    for k in range(n - 1):
        inside[now] = True
        closer = (reach[now] < best) & ~inside
        best[closer], source[closer] = reach[now][closer], now
        now = int(np.where(inside, np.inf, best).argmin())
        made[k] = best[now], source[now], now
    return made


class Condensed:
    """Clusters that grow as edges come in order of length; a component of min_cluster_size points or more is one.

    size, cluster and total (the levels at which its points leave the cluster, summed) are kept for components by their root; home is
    the cluster that a component was first in; ended has (cluster, parent, level of birth, stability)."""

    def __init__(self, least: int, first: int = 0) -> None:
        self.least, self.next = least, first
        self.up: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.cluster: dict[int, int] = {}
        self.total: dict[int, float] = {}
        self.home: dict[int, int] = {}
        self.ended: list[tuple[int, int, float, float]] = []

    def root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            x = up
        return x

    def add(self, edges: list[tuple[float, int, int]]) -> None:
        """Sorted edges (length, a, b), each level whole."""
        at = 0
        while at < len(edges):
            end = at
            while end < len(edges) and edges[end][0] == edges[at][0]:
                end += 1
            self.level(edges[at][0], [(a, b) for _, a, b in edges[at:end]])
            at = end

    def level(self, length: float, pairs: list[tuple[int, int]]) -> None:
        lead: dict[int, int] = {}

        def leader(x: int) -> int:
            while lead.setdefault(x, x) != x:
                lead[x] = x = lead[lead[x]]
            return x

        for a, b in pairs:
            a, b = leader(self.root(a)), leader(self.root(b))
            lead[max(a, b)] = min(a, b)
        joined: dict[int, list[int]] = {}
        for x in lead:
            joined.setdefault(leader(x), []).append(x)
        for parts in joined.values():
            if len(parts) > 1:
                self.join(parts, 1 / length if length > 0 else TOP)

    def join(self, parts: list[int], level: float) -> None:
        size = {p: self.size.get(p, 1) for p in parts}
        whole, large = sum(size.values()), [p for p in parts if p in self.cluster]
        root = max(parts, key=lambda p: (size[p], -p))
        if len(large) > 1 or whole >= self.least:
            if len(large) == 1:
                own, total = self.cluster[large[0]], self.total[large[0]] + (whole - size[large[0]]) * level
            else:
                own, total, self.next = self.next, whole * level, self.next + 1
                self.ended += [(self.cluster[p], own, level, self.total[p] - size[p] * level) for p in large]
            self.home.update((p, own) for p in parts if p not in self.cluster)
            for p in large:
                del self.cluster[p], self.total[p]
            self.cluster[root], self.total[root] = own, total
        self.up.update((p, root) for p in parts if p != root)
        self.size[root] = whole

    def found(self, x: int) -> tuple[int, int | None]:
        """(root, home) of a component, its home being that of the first one on its way up that has one."""
        home = self.home.get(x)
        while (up := self.up.get(x, x)) != x:
            x = up
            home = self.home.get(x) if home is None else home
        return x, home

    def closed(self) -> list[tuple[int, int, float, float]]:
        """All clusters of the whole tree; the root's parent is -1."""
        return self.ended + [(c, -1, 0.0, self.total[r]) for r, c in self.cluster.items()]


def chosen(clusters: list[tuple[int, int, float, float]], method: str) -> dict[int, int]:
    """cluster -> the chosen cluster that it lies in, if any: those of greatest stability (eom) or the leaves; never the root."""
    parent = {c: up for c, up, _, _ in clusters}
    own = {c: s for c, _, _, s in clusters}
    kids: dict[int, list[int]] = {}
    for c, up in parent.items():
        kids.setdefault(up, []).append(c)
    worth: dict[int, float] = {}
    picked: set[int] = set()
    for c in sorted(parent):  # a parent is numbered after its children
        below = sum(worth[k] for k in sorted(kids.get(c, [])))
        alone = parent[c] != -1 and (c not in kids or (method == "eom" and own[c] >= below))
        worth[c] = own[c] if alone else below
        if alone:
            picked.add(c)
    made: dict[int, int] = {}
    for c in sorted(parent, reverse=True):
        above = made.get(parent[c])
        if above is not None:
            made[c] = above
        elif c in picked:
            made[c] = c
    return made


def numbered(found: dict[int, int]) -> dict[int, int]:
    """id -> cluster, numbered from 0 in the order of their smallest ids."""
    first: dict[int, int] = {}
    for i in sorted(found):
        first.setdefault(found[i], len(first))
    return {i: first[c] for i, c in found.items()}


def of_tree(edges: list[tuple[float, int, int]], least: int, method: str, tree: Condensed | None = None) -> dict[int, int]:
    """id -> cluster of the points of a spanning tree that aren't noise."""
    if tree is None:
        tree = condensed(edges, least)
    to = chosen(tree.closed(), method)
    homes = {p: tree.found(p)[1] for _, a, b in edges for p in (a, b)}
    return numbered({p: to[h] for p, h in homes.items() if h in to})


def condensed(edges: list[tuple[float, int, int]], least: int) -> Condensed:
    tree = Condensed(least)
    tree.add(sorted(edges))
    return tree


def density_labels(x: np.ndarray, min_cluster_size: int, min_samples: int, method: str = "eom") -> np.ndarray:
    """Labels of a matrix that one task holds; -1 is noise."""
    n = len(x)
    labels = np.full(n, -1)
    if n < max(2, min_cluster_size):
        return labels
    reach, at = distances(x, x), min(min_samples, n - 1)
    core = np.partition(reach, at, axis=1)[:, at]
    np.maximum(reach, core[:, None], out=reach)
    np.maximum(reach, core[None, :], out=reach)
    tree = [(float(w), int(min(a, b)), int(max(a, b))) for w, a, b in prim(reach)]
    for i, c in of_tree(tree, min_cluster_size, method).items():
        labels[i] = c
    return labels


def distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, v, m): one row for each different vector, named by the least of the m ids that have it, and (id, copy) for the others.

    Vectors that hold nulls or no finite number are left out: nothing lies near them, so they are noise."""
    usable = vectors.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    leaders = written(usable.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")), "leaders")
    crowds = leaders.where("m > 1").select("v", F.col("id").alias("leader"))
    return leaders, written(usable.join(crowds, "v").where("id <> leader").select(F.col("leader").alias("id"), F.col("id").alias("copy")), "copies")


def blocks(leaders: DataFrame, n: int) -> DataFrame:
    """(block, ids, m, v): up to BLOCK vectors as bytes."""
    size = BLOCK

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["ids", "m", "v"])

        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            held.append([b.column(0).to_numpy(), b.column(1).to_numpy(), v])
            while sum(len(h[0]) for h in held) >= size:
                whole = [np.concatenate(c) for c in zip(*held)]
                yield packed([c[:size] for c in whole])
                held = [[c[size:] for c in whole]] if len(whole[0]) > size else []
        if held:
            yield packed([np.concatenate(c) for c in zip(*held)])

    rows = leaders.select(F.col("id").cast("long").alias("id"), F.col("m").cast("long").alias("m"), F.col("v").cast("array<double>").alias("v"))
    made = rows.repartition(max(1, n // (4 * BLOCK)), "id").mapInArrow(kernel, "ids binary, m binary, v binary")
    return written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def cells(blocked: DataFrame) -> DataFrame:
    """Blocks dealt to cells (g, h), g no greater than h: every two groups of blocks meet in one; each cell is a task's work of its own."""
    count = blocked.count()
    sides = max(1, -(-count // GROUP), min(count, SIDES))
    order = blocked.select("block").orderBy("block").collect()  # a row for each block
    side = blocked.sparkSession.createDataFrame([(r["block"], i % sides) for i, r in enumerate(order)], "block long, side int")
    other = F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    dealt = blocked.join(F.broadcast(side), "block").withColumn("other", other).select("*", F.least("side", "other").alias("g"), F.greatest("side", "other").alias("h")).drop("other")
    return dealt.repartition(sides * (sides + 1) // 2, "g", "h")


class Held:
    """A block in a task, and for each layer the nearest that its wanted rows have met: lengths, ids and numbers of copies."""

    def __init__(self, row: dict, layers: int, most: int) -> None:
        self.side, self.block = row["side"], row["block"]
        self.ids, self.m = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["m"], np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(row["v"], np.float64).reshape(n, -1)
        self.squares = (self.x * self.x).sum(axis=1)
        self.core = [np.frombuffer(c, np.float64) for c in row.get("cores") or [np.zeros(n).tobytes()] * layers]
        self.own = [np.frombuffer(c, np.int64) for c in row.get("own") or [row["ids"]] * layers]
        wanted = row.get("wanted") or [np.ones(n, bool).tobytes()] * layers
        self.rows = [np.flatnonzero(np.frombuffer(w, bool)) for w in wanted]
        self.every = np.unique(np.concatenate(self.rows))
        self.best = [(np.full((len(r), most), np.inf), np.full((len(r), most), -1), np.zeros((len(r), most), np.int64)) for r in self.rows]


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a to the same rows of b, to the bit those of distances()."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        step = a[:, i] - b[:, i]
        total += step * step
    return np.sqrt(total, out=total)


def least(best: tuple[np.ndarray, ...], rows: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
    """Takes what was found for rows into the best of them, in place; the best are in order."""
    some, at = np.unique(rows, return_inverse=True)
    most = best[0].shape[1]
    row = np.concatenate([np.repeat(np.arange(len(some)), most), at])
    both = [np.concatenate([b[some].ravel(), f]) for b, f in zip(best, found)]
    order = np.lexsort((both[0], row))
    row = row[order]
    first = np.searchsorted(row, np.arange(len(some)))
    kept = order[(first[:, None] + np.arange(most)).ravel()]
    for b, x in zip(best, both):
        b[some] = x[kept].reshape(len(some), most)


def meet(p: Held, q: Held, most: int) -> None:
    """The wanted rows of p look through q for the nearest outside their own component.

    Lengths from one product of matrices choose the candidates, with room for their rounding; those are then measured exactly."""
    if not len(p.every):
        return
    top = max(p.squares.max(), q.squares.max())
    room = 16 * (p.x.shape[1] + 8) * np.finfo(float).eps * top
    near = p.x[p.every] @ q.x.T
    near *= -2
    near += p.squares[p.every, None]
    near += q.squares
    for k, rows in enumerate(p.rows):
        if not len(rows):
            continue
        apart = near if len(rows) == len(p.every) and len(p.rows) == 1 else near[np.searchsorted(p.every, rows)]
        if p.core[k].any() or q.core[k].any():
            apart = np.maximum(apart, q.core[k] ** 2)
            np.maximum(apart, p.core[k][rows, None] ** 2, out=apart)
        apart[p.own[k][rows, None] == q.own[k]] = np.inf
        worst = p.best[k][0][:, -1]
        limit = worst * worst * (1 + 1e-9) + room
        fresh = np.flatnonzero(np.isinf(limit))
        if len(fresh) and apart.shape[1] > most:
            limit[fresh] = np.partition(apart[fresh], most - 1, axis=1)[:, most - 1] * (1 + 1e-9) + 2 * room
        np.minimum(limit, np.finfo(float).max, out=limit)
        r, c = np.nonzero(apart <= limit[:, None])
        if len(r):
            length = np.maximum(np.maximum(between(p.x[rows[r]], q.x[c]), p.core[k][rows[r]]), q.core[k][c])
            least(p.best[k], r, (length, q.ids[c], q.m[c]))


def nearest(blocked: DataFrame, most: int, layers: int) -> DataFrame:
    """(block, layer, ids, w, to, m): for the wanted rows of each layer the least lengths to vectors outside their components, in order.

    A length is the greatest of a distance and both core distances. Blocks say cores, own (components) and wanted for each layer;
    without these every row looks for its nearest."""

    def kernel(part: pa.Table) -> pa.Table:
        g, h = part["g"][0].as_py(), part["h"][0].as_py()
        held = [Held(r, layers, most) for r in part.to_pylist()]
        for p in held:
            for q in held:
                if g == h or p.side != q.side:
                    meet(p, q, most)
        out = [(p.block, k, p.ids[rows].tobytes(), *(b.tobytes() for b in best)) for p in held for k, (rows, best) in enumerate(zip(p.rows, p.best)) if len(rows)]
        return pa.table({name: pa.array([o[i] for o in out], t) for i, (name, t) in enumerate(zip(("block", "layer", "ids", "w", "to", "m"), (pa.int64(), pa.int32(), *[pa.binary()] * 4)))})

    def merged(part: pa.Table) -> pa.Table:
        every = [np.concatenate([np.frombuffer(x, t).reshape(-1, most) for x in part[c].to_pylist()], axis=1) for c, t in (("w", np.float64), ("to", np.int64), ("m", np.int64))]
        order = np.argsort(every[0], axis=1, kind="stable")[:, :most]
        made = [pa.array([np.take_along_axis(e, order, axis=1).tobytes()], pa.binary()) for e in every]
        return pa.table([part["block"][:1], part["layer"][:1], part["ids"][:1], *made], ["block", "layer", "ids", "w", "to", "m"])

    kind = "block long, layer int, ids binary, w binary, to binary, m binary"
    found = cells(blocked).groupBy("g", "h").applyInArrow(kernel, kind)
    return written(found.groupBy("block", "layer").applyInArrow(merged, kind), "nearest")


def lists(found: DataFrame, most: int) -> DataFrame:
    """(layer, id, radius, near of (w, to)) of what nearest() found; what isn't in a row's list lies at radius or further."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, w, to = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["w"], np.float64), np.frombuffer(r["to"], np.int64)
                near = pa.StructArray.from_arrays([pa.array(w), pa.array(to)], ["w", "to"])
                near = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, most), pa.int32()), near)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["layer"]), pa.int32()), pa.array(ids), pa.array(w[most - 1 :: most]), near], ["layer", "id", "radius", "near"])

    return found.select("layer", "ids", "w", "to").mapInArrow(kernel, "layer int, id long, radius double, near array<struct<w: double, to: long>>")


def cored(blocked: DataFrame, found: DataFrame, samples: list[int], most: int) -> DataFrame:
    """Blocks with the core distances of their vectors for each number of samples; copies count."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["m"], np.int64)
                w, reached = np.frombuffer(r["w"], np.float64).reshape(-1, most), np.frombuffer(r["others"], np.int64).reshape(-1, most).cumsum(axis=1)
                # equal vectors, at distance 0, come first
                w, reached = np.hstack([np.zeros((len(w), 1)), w]), np.hstack([np.zeros((len(w), 1), np.int64), reached]) + (own - 1)[:, None]
                made = [w[np.arange(len(w)), (reached >= s).argmax(axis=1)].tobytes() for s in samples]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]], t) for c, t in (("block", pa.int64()), ("ids", pa.binary()), ("m", pa.binary()), ("v", pa.binary()))), pa.array([made], pa.list_(pa.binary()))], ["block", "ids", "m", "v", "cores"])

    both = blocked.join(found.select("block", "w", F.col("m").alias("others")), "block")
    return written(both.mapInArrow(kernel, "block long, ids binary, m binary, v binary, cores array<binary>"), "cored")


def named(ready: DataFrame, samples: list[int]) -> DataFrame:
    """(block, place, id, cores) of the rows of blocks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                cores = pa.array(list(np.stack([np.frombuffer(c, np.float64) for c in r["cores"]], axis=1)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["block"])), pa.array(np.arange(len(ids))), pa.array(ids), cores], ["block", "place", "id", "cores"])

    return ready.select("block", "ids", "cores").mapInArrow(kernel, "block long, place long, id long, cores array<double>")


def marked(ready: DataFrame, rows: DataFrame, own: DataFrame) -> DataFrame:
    """Blocks with the component of each row and whether it is wanted, for own(layer, id, node, wanted)."""

    def packed(part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        node, wanted = np.array(part["node"].to_pylist(), np.int64), np.array(part["wanted"].to_pylist(), bool)
        made = [pa.array([[x[:, i].tobytes() for i in range(x.shape[1])]], pa.list_(pa.binary())) for x in (node, wanted)]
        return pa.table([part["block"][:1], *made], ["block", "own", "wanted"])

    each = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("layer", "node", "wanted"))).alias("e")).select("id", F.col("e.node").alias("node"), F.col("e.wanted").alias("wanted"))
    made = rows.select("block", "place", "id").join(each, "id").select("block", "place", "node", "wanted").groupBy("block").applyInArrow(packed, "block long, own array<binary>, wanted array<binary>")
    return written(ready.join(made, "block"), "marked")


def grown(w: np.ndarray, a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which edges are surely in the spanning tree, the root of each node) for edges among nodes 0 to len(reach) - 1.

    reach[x] is a length below which no edge leaves x but those given. In the order of length an edge is the least known one to leave
    both components that it joins; it is the least of all where either has no unknown edge below it."""
    up, reach, kept = list(range(len(reach))), reach.tolist(), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    order = np.argsort(w, kind="stable")
    for at in range(0, len(order), 1 << 17):  # a part at a time: lists of all edges would be large
        part = order[at : at + (1 << 17)]
        for e, length, x, y in zip(part.tolist(), w[part].tolist(), a[part].tolist(), b[part].tolist()):
            x, y = root(x), root(y)
            if x != y and (length <= reach[x] or length <= reach[y]):
                up[y] = x
                reach[x] = min(reach[x], reach[y])
                kept.append(e)
    return np.array(kept, np.int64), np.array([root(x) for x in range(len(up))], np.int64)


def ended(part: pa.Table) -> pa.Table:
    """The end of spanning() for a layer's edges: (kind, layer, w, a, b, ca, cb)."""
    w, a, b, ca, cb = (part[c].to_numpy() for c in ("w", "a", "b", "ca", "cb"))
    nodes, at = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    reach = np.empty(len(nodes))
    reach[at] = np.concatenate([part["ra"].to_numpy(), part["rb"].to_numpy()])
    x, y = at[: len(w)], at[len(w) :]
    kept, root = grown(w, x, y, reach)
    rest = np.flatnonzero(root[x] != root[y])
    none = np.zeros(len(nodes), np.int64)
    out = [(np.full(len(e), k), w[e], a[e], b[e], nodes[root[x[e]]], nodes[root[y[e]]]) for k, e in ((0, kept), (1, rest))]
    out.append((np.full(len(nodes), 2), np.zeros(len(nodes)), nodes, nodes[root], none, none))
    made = [np.concatenate(c) for c in zip(*out)]
    return pa.table([pa.array(made[0], pa.int32()), pa.array(np.full(len(made[0]), part["layer"][0].as_py()), pa.int32()), *(pa.array(c) for c in made[1:])], ["kind", "layer", "w", "a", "b", "ca", "cb"])


def spanning(live: DataFrame, reach: DataFrame, layers: int, local: int = LOCAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sure edges of the spanning trees (layer, w, a, b), edges that stay between components, (layer, id, node) of the nodes joined).

    live(layer, w, a, b, ca, cb) has known edges and the nodes that they join, reach(layer, node, radius) how far they are all known."""
    sure: list[DataFrame] = []
    last: list[DataFrame] = []
    moves: list[DataFrame] = []
    pair = ("layer", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
    live = live.where("ca <> cb").select(*pair, F.struct("w", "a", "b").alias("e")).groupBy("layer", "ca", "cb").agg(F.min("e").alias("e")).select("layer", "e.*", "ca", "cb")
    live = written(live, "edges")
    sizes = {r["layer"]: r["count"] for r in live.groupBy("layer").count().collect()}
    for k in range(layers):
        own, known, count, moved = live.where(F.col("layer") == k), reach.where(F.col("layer") == k), sizes.get(k, 0), None
        while count > local:
            turned = own.unionByName(own.select("layer", "w", "a", "b", F.col("cb").alias("ca"), F.col("ca").alias("cb")))
            first = turned.groupBy("ca").agg(F.min(F.struct("w", "a", "b", "cb")).alias("m")).select("ca", "m.*")
            first = written(first.join(known.select(F.col("node").alias("ca"), "radius"), "ca").where("w <= radius").drop("radius"), "least")
            if first.isEmpty():
                break
            sure.append(first.select(F.lit(k).alias("layer"), "w", "a", "b").distinct())
            to = written(groups(first.select(F.col("ca").alias("canonical"), F.col("cb").alias("duplicate"))), "to")
            left, right = (to.select(F.col("seq").alias(c), F.col("group").alias(f"to_{c}")) for c in ("ca", "cb"))
            over = own.join(left, "ca", "left").join(right, "cb", "left").select("layer", "w", "a", "b", F.coalesce("to_ca", "ca").alias("ca"), F.coalesce("to_cb", "cb").alias("cb"))
            over = over.where("ca <> cb").select(*pair, F.struct("w", "a", "b").alias("e"))
            own = written(over.groupBy("layer", "ca", "cb").agg(F.min("e").alias("e")).select("layer", "e.*", "ca", "cb"), "edges")
            step = to.select(F.col("seq").alias("node"), "group")
            known = written(known.join(step, "node", "left").groupBy(F.coalesce("group", "node").alias("node")).agg(F.min("radius").alias("radius")).withColumn("layer", F.lit(k)), "reach")
            start = reach.where(F.col("layer") == k).select(F.col("node").alias("id"), "node") if moved is None else moved
            moved = written(start.join(step, "node", "left").select("id", F.coalesce("group", "node").alias("node")), "moved")
            count = own.count()
        if moved is not None:
            moves.append(moved.withColumn("layer", F.lit(k)))
        if count <= local:
            both = own.join(known.select(F.col("node").alias("ca"), F.col("radius").alias("ra")), "ca").join(known.select(F.col("node").alias("cb"), F.col("radius").alias("rb")), "cb")
            last.append(both.select("layer", "w", "a", "b", "ca", "cb", "ra", "rb"))
        else:
            last.append(own.select(F.lit(1).alias("kind"), "layer", "w", "a", "b", "ca", "cb"))
    small = [x for x in last if "ra" in x.columns]
    large = [x for x in last if "ra" not in x.columns]
    done = joined_rows(small).repartition(4 * layers, "layer").groupBy("layer").applyInArrow(ended, "kind int, layer int, w double, a long, b long, ca long, cb long") if small else None
    done = written(joined_rows(([done] if done is not None else []) + large), "spanned")
    tree = joined_rows([done.where("kind = 0").select("layer", "w", "a", "b"), *(x.select(F.col("layer").cast("int").alias("layer"), "w", "a", "b") for x in sure)])
    over = done.where("kind = 2").select("layer", F.col("a").alias("node"), F.col("b").alias("to"))
    start = reach.select("layer", F.col("node").alias("id"), "node")
    if moves:
        some = joined_rows([m.select(F.col("layer").cast("int").alias("layer"), "id", F.col("node").alias("new")) for m in moves])
        start = start.join(some, ["layer", "id"], "left").select("layer", "id", F.coalesce("new", "node").alias("node"))
    nodes = start.join(over, ["layer", "node"], "left").select("layer", "id", F.coalesce("to", "node").alias("node"))
    return tree, done.where("kind = 1").drop("kind"), nodes


def joined_rows(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole


def trees(leaders: DataFrame, copies: DataFrame, n: int, samples: list[int], local: int = LOCAL) -> DataFrame:
    """(samples, w, a, b): the edges of a spanning tree of mutual reachability for each number of samples.

    Every vector's nearest give most edges surely; the components that they leave, without the largest, then look for their
    least edges among all vectors, rows whose unknown edges can't be the least excepted, until there is one component."""
    layers, spark = len(samples), leaders.sparkSession
    blocked = blocks(leaders, n)
    most = min(2 * samples[-1], max(n - 1, 1))
    found = nearest(blocked, most, 1)
    ready = cored(blocked, found, samples, most)
    rows = written(named(ready, samples), "named")
    cores = rows.select(F.col("id").alias("to"), F.col("cores").alias("there"))
    near = lists(found, most).select("id", "radius", F.explode("near").alias("e")).select("id", "radius", "e.*").where("to >= 0")
    both = near.join(rows.select("id", "cores"), "id").join(cores, "to")
    edges = both.select(F.col("id").alias("a"), F.col("to").alias("b"), "w", F.posexplode(F.arrays_zip("cores", "there")).alias("layer", "c"))
    edges = edges.select("layer", F.greatest("w", "c.cores", "c.there").alias("w"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = edges.select("*", F.col("a").alias("ca"), F.col("b").alias("cb"))
    every = F.explode(F.array(*(F.lit(k) for k in range(layers)))).alias("layer")
    radius = written(lists(found, most).select("id", "radius", every).select("layer", "id", "radius"), "radius")
    own = radius.select("layer", "id", F.col("id").alias("node"))
    made: list[DataFrame] = []
    left = None
    while True:
        reach = written(radius.join(own, ["layer", "id"]).groupBy("layer", "node").agg(F.min("radius").alias("radius")), "reach")
        tree, rest, to = spanning(live, reach, layers, local)
        made.append(tree)
        own = written(own.join(to.select("layer", F.col("id").alias("node"), F.col("node").alias("over")), ["layer", "node"]).select("layer", "id", F.col("over").alias("node")), "own")
        sizes = written(own.groupBy("layer", "node").agg(F.count(F.lit(1)).alias("n")), "sizes")
        before, left = left, sizes.count()
        if left == layers or left == before:
            break
        largest = sizes.groupBy("layer").agg(F.max_by("node", F.struct("n", "node")).alias("node"))
        ends = rest.select("layer", "w", F.explode(F.array("ca", "cb")).alias("node")).groupBy("layer", "node").agg(F.min("w").alias("w"))
        asking = sizes.join(largest, ["layer", "node"], "left_anti").join(ends, ["layer", "node"], "left").select("layer", "node", F.coalesce("w", F.lit(float("inf"))).alias("w"))
        wanted = own.join(asking, ["layer", "node"], "left").join(radius, ["layer", "id"]).select("layer", "id", "node", F.coalesce(F.col("radius") < F.col("w"), F.lit(False)).alias("wanted"))
        wanted = written(wanted, "wanted")
        some = min(MORE, n)
        found = lists(nearest(marked(ready, rows, wanted), some, layers), some)
        new = found.select("layer", "id", F.explode("near").alias("e")).select("layer", F.col("e.w").alias("w"), F.col("id").alias("a"), F.col("e.to").alias("b")).where("b >= 0")
        for c in ("a", "b"):
            new = new.join(own.select("layer", F.col("id").alias(c), F.col("node").alias(f"c{c}")), ["layer", c])
        live = rest.unionByName(new.select("layer", "w", "a", "b", "ca", "cb"))
        further = found.select("layer", "id", F.col("radius").alias("further"))
        radius = written(radius.join(further, ["layer", "id"], "left").select("layer", "id", F.coalesce("further", "radius").alias("radius")), "radius")
    again = rows.join(copies, "id").select(F.col("id").alias("a"), F.col("copy").alias("b"), F.posexplode("cores").alias("layer", "w")).select("layer", "w", "a", "b")
    number = F.element_at(F.array(*(F.lit(s) for s in samples)), F.col("layer") + 1)
    return written(joined_rows([*made, again]).select(number.alias("samples"), "w", "a", "b"), "trees")


def banded(tree: DataFrame, least: int, band: int = BAND) -> tuple[DataFrame, list[tuple[int, int, float, float]]]:
    """(id, home) of the points that are in some cluster, and the condensed tree's rows, for edges (w, a, b) of a spanning tree."""
    count = tree.count()
    ends = sorted(set(tree.approxQuantile("w", [i / -(-count // band) for i in range(1, -(-count // band))], 0.001))) if count > band else []
    points = written(tree.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("node"), F.lit(None).cast("long").alias("home")), "points")
    state = tree.sparkSession.createDataFrame([], "node long, size long, cluster long, total double")
    ended: list[tuple[int, int, float, float]] = []
    for n, (low, high) in enumerate(zip([-1.0, *ends], [*ends, float("inf")])):
        own = tree.where((F.col("w") > low) & (F.col("w") <= high))
        for c in ("a", "b"):
            own = own.join(points.select(F.col("id").alias(c), F.col("node").alias(f"n{c}")), c).join(state.select(F.col("node").alias(f"n{c}"), *(F.col(x).alias(f"{x}_{c}") for x in ("size", "cluster", "total"))), f"n{c}", "left")

        def kernel(batches: Iterator[pa.RecordBatch], first: int = n << 40) -> Iterator[pa.RecordBatch]:
            work, rows = Condensed(least, first), []
            for b in batches:
                for w, x, y, *facts in zip(*(c.to_pylist() for c in b.columns)):
                    rows.append((w, x, y))
                    for node, (size, cluster, total) in ((x, facts[:3]), (y, facts[3:])):
                        if size is not None:
                            work.size[node] = size
                        if cluster is not None:
                            work.cluster[node], work.total[node] = cluster, total
            work.add(sorted(rows))
            nodes = {p for _, x, y in rows for p in (x, y)}
            out = [("node", p, *work.found(p), None, None) for p in nodes]
            out += [("state", r, work.size[r], work.cluster.get(r), work.total.get(r), None) for r in {o[2] for o in out}]
            out += [("ended", c, up, None, born, worth) for c, up, born, worth in work.ended]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["kind", "a", "b", "c", "x", "y"])

        facts = [f"{x}_{c}" for c in ("a", "b") for x in ("size", "cluster", "total")]
        done = written(own.select("w", "na", "nb", *facts).repartition(1).mapInArrow(kernel, "kind string, a long, b long, c long, x double, y double"), "band")
        ended += [(r["a"], r["b"], r["x"], r["y"]) for r in done.where("kind = 'ended'").collect()]
        moved = done.where("kind = 'node'").select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("c").alias("new"))
        points = written(points.join(moved, "node", "left").select("id", F.coalesce("to", "node").alias("node"), F.coalesce("home", "new").alias("home")), "points")
        fresh = done.where("kind = 'state'").select(F.col("a").alias("node"), F.col("b").alias("size"), F.col("c").alias("cluster"), F.col("x").alias("total"))
        state = written(state.join(moved, "node", "left_anti").unionByName(fresh), "state")
    ended += [(r["cluster"], -1, 0.0, r["total"]) for r in state.where("cluster IS NOT NULL").collect()]
    return points.where("home IS NOT NULL").select("id", "home"), ended


def whole_tree(settings: list[Setting]) -> Callable[[pa.Table], pa.Table]:
    """The clusters of a tree that one task holds, for the least size that stands beside its edges and each method asked with it."""

    def kernel(part: pa.Table) -> pa.Table:
        least, samples = part["least"][0].as_py(), part["samples"][0].as_py()
        edges = list(zip(*(part[c].to_pylist() for c in ("w", "a", "b"))))
        grown, rows = condensed(edges, least), []
        for method in (m for m, c, s in settings if (c, s) == (least, samples)):
            rows += [(method, least, samples, i, c) for i, c in of_tree(edges, least, method, grown).items()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(zip(LABELLED, kinds))})

    return kernel


LABELLED = ("method", "min_cluster_size", "min_samples", "id", "cluster_id")


def clusterings(vectors: DataFrame, settings: list[Setting], band: int = BAND, local: int = LOCAL) -> DataFrame:
    """(method, min_cluster_size, min_samples, id, cluster_id) for each setting and vector; -1 is noise.

    Clusters are numbered by their smallest ids."""
    spark = vectors.sparkSession
    vectors = written(vectors.select("id", F.col("v").cast("array<double>").alias("v")), "vectors")
    every = vectors.select("id").join(F.broadcast(spark.createDataFrame(settings, "method string, min_cluster_size int, min_samples int")))
    out = "method string, min_cluster_size int, min_samples int, id long, cluster_id int"
    leaders, copies = distinct(vectors)
    alone = leaders.count()
    n = alone + copies.count()
    if n < 2:
        return every.withColumn("cluster_id", F.lit(-1)).select(*LABELLED)
    samples = sorted({s for _, _, s in settings})
    tree = trees(leaders, copies, alone, sorted({min(s, n - 1) for s in samples}), local)
    met = joined_rows([tree.where(F.col("samples") == min(s, n - 1)).withColumn("samples", F.lit(s)) for s in samples])
    made: list[DataFrame] = []
    if n - 1 <= band:
        asked = sorted({(c, s) for _, c, s in settings})
        grid = F.broadcast(spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(asked)], "least int, samples int, task int"))
        dealt = met.join(grid, "samples").repartitionByRange(len(asked), "task")
        made.append(dealt.groupBy("task").applyInArrow(whole_tree(settings), out))
    for s in samples if not made else ():
        own = [(m, c) for m, c, k in settings if k == s]
        for c in sorted({c for _, c in own}):
            homes, ended = banded(written(met.where(F.col("samples") == s).drop("samples"), "tree"), c, band)
            for m in (m for m, k in own if k == c):
                to = spark.createDataFrame(list(chosen(ended, m).items()), "home long, top long")
                found = written(homes.join(to, "home").select("id", "top"), "found")
                first = [r["top"] for r in found.groupBy("top").agg(F.min("id").alias("least")).orderBy("least").collect()]  # of clusters chosen
                order = spark.createDataFrame([(t, i) for i, t in enumerate(first)], "top long, cluster_id int")
                made.append(found.join(order, "top").select(F.lit(m).alias("method"), F.lit(c).alias("min_cluster_size"), F.lit(s).alias("min_samples"), "id", "cluster_id"))
    found = written(joined_rows(made), "clusters")
    keys = list(LABELLED[:-1])
    return every.join(found, keys, "left").select(*keys, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
