"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. Each document's ids (its own id END last) are cut into whole sequences of
   CAPACITY and a rest. A rest of EXACT or more is cut again into a multiple of
   GRID and a tail, so that few lengths occur, whatever the number of documents.
2. The histogram of piece lengths (at most EXACT + CAPACITY / GRID rows) goes to
   the driver. A linear program over patterns (how often each length lies in one
   sequence) is solved by column generation: a knapsack dynamic program over the
   dual prices finds the next pattern, until the bound shows that none helps.
3. The patterns are used as often as the whole part of the solution says. What
   rounding leaves, a number bounded by the patterns, is packed best-fit; bins
   that stay open are joined and cut at CAPACITY, the last one at powers of two,
   which need no padding.
4. Pieces are ranked within their length (counts by salt, then running sums in two
   steps, so no length meets in one task) and a rank's pattern copy is arithmetic: a join
   to a plan whose size depends on the lengths only.
5. The few documents cut in step 3 are encoded once more for their checksums.

Defined results: null and empty texts hold END alone; an empty table gives no
rows; repeated rows are packed once each; ties in rank go by key, start and
checksum; null keys are packed too; other columns are not read.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import attach, table
from .bpe import CHARS, codec, default_path
from .shared import borrowed, sized, slices, stage, two

CAPACITY, END = 2048, 1
EXACT, GRID = 128, 32
SALTS, FAN = 4096, 64
GAP = 1e-4
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
Cut = list[tuple[int, int]]


def cuts(n: int, capacity: int = CAPACITY) -> Cut:
    """(start, length) of the pieces of a document of n ids."""
    made = [(at, capacity) for at in range(0, n - capacity + 1, capacity)]
    at, rest = len(made) * capacity, n % capacity
    if rest >= EXACT and rest % GRID:
        made.append((at, rest - rest % GRID))
        at, rest = at + rest - rest % GRID, rest % GRID
    return [*made, (at, rest)] if rest else made


def pieces(df: DataFrame, key: str, text: str, path: str, capacity: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        with borrowed():
            for b in sized(batches, 1, CHARS):
                ids, ends = known.encode_all(b.column(1).to_pylist())
                # END goes behind each document's ids
                every = np.insert(ids, ends[1:], END).astype("<u4")
                raw, first = memoryview(every).cast("B"), ends[:-1] + np.arange(len(ends) - 1)
                total = np.diff(ends) + 1
                cut = [cuts(n, capacity) for n in total.tolist()]
                times = np.fromiter(map(len, cut), np.int64, len(cut))
                at, size = np.array([x for c in cut for x in c], np.int64).reshape(-1, 2).T
                begin = 4 * (np.repeat(first, times) + at)
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(begin.tolist(), (begin + 4 * size).tolist())]
                which = np.repeat(np.arange(len(cut)), times)
                made = [b.column(0).take(pa.array(which)), pa.array(at), pa.array(size), pa.array(crc, pa.int64()), pa.array(total[which])]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return two(df, key, text).mapInArrow(kernel, PIECE)


def steps(size: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For each capacity the smaller capacities that one more piece of each (ascending) size leaves."""
    return [c - size[: np.searchsorted(size, c, side="right")] for c in range(capacity + 1)]


def price(duals: np.ndarray, size: np.ndarray, left: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """The pattern of the greatest value under the prices, by unbounded-knapsack dynamic programming."""
    best, pick = np.zeros(len(left)), [-1] * len(left)
    for c in range(1, len(left)):
        best[c] = best[c - 1]
        if k := len(left[c]):
            got = best[left[c]]
            got += duals[:k]
            i = got.argmax()
            if got[i] > best[c]:
                best[c], pick[c] = got[i], i
    pattern, c = np.zeros(len(size)), len(left) - 1
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(size[pick[c]])
    return float(best[-1]), pattern


def solve(lengths: list[int], counts: list[int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each; stops within gap of the bound."""
    size, need = np.array(lengths), np.array(counts, float)  # lengths ascend
    m, left = len(size), steps(size, capacity)
    columns = np.diag((capacity // size).astype(float))
    inverse, used = np.diag(1 / np.diag(columns)), need / np.diag(columns)
    floor = float(size @ need) / capacity
    for _ in range(40 * m + 100):
        duals = inverse.sum(axis=0)
        value, pattern = price(duals, size, left)
        total = used.sum()
        if value <= 1 + 1e-9 or total <= (1 + gap) * max(floor, total / value):
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        used -= ratio[out] * step
        used[out] = ratio[out]
        np.maximum(used, 0, out=used)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = pattern
    return [(columns[:, j], float(used[j])) for j in range(m) if used[j] > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], list[tuple]]:
    """Segments (length, first rank, last rank, copies, sequence, offset) for whole pieces, and for the
    pieces that are cut again (length, rank, part start, part length, sequence, offset). Ranks start at 0."""
    left = Counter({k: n for k, n in histogram.items() if n})
    ranks: Counter = Counter()
    whole, parts, sequence = [], [], 0
    if full := left.pop(capacity, 0):
        whole.append((capacity, 0, full - 1, 1, 0, 0))
        sequence = full
    if left:
        lengths = sorted(left)
        for pattern, often in sorted(solve(lengths, [left[k] for k in lengths], capacity), key=lambda x: -x[1]):
            copies = [(k, int(a)) for k, a in zip(lengths, pattern) if a]
            times = min([int(often + 1e-6), *(left[k] // a for k, a in copies)])
            if not times:
                continue
            at = 0
            for k, a in copies:
                whole.append((k, ranks[k], ranks[k] + a * times - 1, a, sequence, at))
                ranks[k] += a * times
                left[k] -= a * times
                at += a * k
            sequence += times
    # What rounding left: less than one sequence for each pattern.
    bins: list[tuple[int, list[int]]] = []
    for k in sorted(left, reverse=True):
        for _ in range(left[k]):
            fit = max((i for i, (room, _) in enumerate(bins) if room >= k), key=lambda i: -bins[i][0], default=None)
            if fit is None:
                bins.append((capacity - k, [k]))
            else:
                bins[fit] = (bins[fit][0] - k, [*bins[fit][1], k])
    open_items: list[int] = []
    for room, items in bins:
        if room and capacity - room & capacity - room - 1:
            open_items += items
            continue
        at = 0
        for k in items:
            whole.append((k, ranks[k], ranks[k], 1, sequence, at))
            ranks[k] += 1
            at += k
        sequence += 1
    total = sum(open_items)
    rest = total % capacity
    ends = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]
    # the last, open sequence becomes sequences of powers of two
    marks, at = [], total - rest
    for e in ends:
        marks.append((at, e))
        at += e

    def laid(at: int, k: int) -> Iterator[tuple[int, int, int, int]]:
        done = 0
        while done < k:
            here = at + done
            if here < total - rest:
                number, begin, room = here // capacity, here // capacity * capacity, capacity
            else:
                number, (begin, room) = next(((total - rest) // capacity + i, m) for i, m in enumerate(marks) if m[0] <= here < m[0] + m[1])
            part = min(k - done, begin + room - here)
            yield done, part, sequence + number, here - begin
            done += part

    at = 0
    for k in open_items:
        found = list(laid(at, k))
        if len(found) == 1:
            whole.append((k, ranks[k], ranks[k], 1, *found[0][2:]))
        else:
            parts += [(k, ranks[k], *x) for x in found]
        ranks[k] += 1
        at += k
    return whole, parts


def ranked(made: DataFrame) -> DataFrame:
    """made with the rank from 0 of each piece among those of its length, without gathering a length in one task.

    Counts by salt become running sums in two steps, over at most SALTS / FAN rows and over FAN rows of a length."""
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("fan", F.expr(f"salt div {FAN}"))
    before = lambda key, order: Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upper = counts.groupBy("length", "fan").agg(F.sum("n").alias("n"))
    upper = upper.select("length", "fan", F.coalesce(F.sum("n").over(before(["length"], "fan")), F.lit(0)).alias("above"))
    inner = counts.select("length", "fan", "salt", F.coalesce(F.sum("n").over(before(["length", "fan"], "salt")), F.lit(0)).alias("within"))
    base = inner.join(upper, ["length", "fan"]).select("length", "salt", (F.col("above") + F.col("within")).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    within = salted.withColumn("at", F.row_number().over(own) - 1)
    return within.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("at")).drop("salt", "base", "at")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, path = df.sparkSession, path or default_path()
    made = stage(pieces(df, key, text, path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole, parts = plan(histogram, capacity)
    slots = F.broadcast(spark.createDataFrame(whole, "l long, lo long, hi long, copies long, seq long, off long"))
    at = F.col("rank") - F.col("lo")
    order = ranked(made)
    kept = order.join(slots, (F.col("length") == F.col("l")) & F.col("rank").between(F.col("lo"), F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("seq") + F.expr("(rank - lo) div copies")).alias("sequence_id"),
        (F.col("off") + at % F.col("copies") * F.col("length")).alias("offset"),
    )
    if not parts:
        return kept
    again = F.broadcast(spark.createDataFrame(parts, "l long, r long, part long, part_length long, sequence_id long, offset long"))
    few = order.join(again, (F.col("length") == F.col("l")) & (F.col("rank") == F.col("r")))
    few = stage(few.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "part_length", "sequence_id", "offset"), "cut")
    # at most a bounded number of pieces are cut again; equal pieces of equal keys are interchangeable
    own = F.broadcast(few.select(F.col("doc_id").alias("own")).distinct())
    texts = two(df, key, text).join(own, F.col("doc_id").eqNullSafe(F.col("own"))).select("doc_id", "text").distinct()
    asked = few.groupBy(F.col("doc_id").alias("own")).agg(F.collect_set(F.struct("start", "length", "ids_crc32", "part", "part_length")).alias("asked"))
    joined = texts.join(F.broadcast(asked), F.col("doc_id").eqNullSafe(F.col("own"))).select("doc_id", "text", "asked")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for b in slices(batches):
            rows = []
            for doc, x, wanted in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.array([*encode(x), END], "<u4").tobytes()
                for w in wanted:
                    piece = ids[4 * w["start"] : 4 * (w["start"] + w["length"])]
                    if len(piece) == 4 * w["length"] and zlib.crc32(piece) == w["ids_crc32"]:
                        cut = piece[4 * w["part"] : 4 * (w["part"] + w["part_length"])]
                        rows.append((doc, w["start"], w["length"], w["ids_crc32"], w["part"], w["part_length"], zlib.crc32(cut)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], NAMES)

    NAMES = ["d", "s", "n", "c", "p", "k", "crc"]
    sums = joined.mapInArrow(kernel, ", ".join(f"{x} long" for x in NAMES)).distinct()
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(("doc_id", "start", "length", "ids_crc32", "part", "part_length"), NAMES)]
    rest = few.join(sums, on).select(
        "doc_id", (F.col("start") + F.col("part")).alias("start"), F.col("part_length").alias("length"),
        F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )
    return kept.unionByName(rest)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    attach(spark)
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
