"""Repair of conversation structure: cheapest edits by Dijkstra on a lattice of turns and grammar states.

A well-formed conversation is empty, or an optional system turn followed by pairs of
user and assistant: initials `(s?(ua)+)?`. A node of the lattice is (rows read, state
of that grammar); its edges are the edits: keep a row, give it the other role, delete
it, insert an empty turn. The search grows from the start by the priority (cost,
audit), audit being the edits' initials so far, and ends at the first accepting node
behind the last row that it pops; nodes are made when they are reached. Two paths of
equal cost to one node never have one audit as the other's prefix (only inserts come
without a row, and they cost), so the least audit of a node stays least whatever follows.

At scale: equal rows (conversation, turn, role, text) are counted before anything else,
as all but the first are faults. What is left is dealt by range of (conversation, turn,
role, text), so a conversation of any length is cut over many tasks. A task reads its
sorted rows in segments of at most SEGMENT rows or AT_ONCE characters. A conversation
that lies inside one segment is finished there. A longer one, or one at the edge of a
task, leaves a summary for each segment: for each state at its start the cheapest audit to each
state at its end. Summaries are composed in order (they hold initials, no texts:
about as much as the audit that the result's one row holds), the chosen audits go back
to the segments' rows, and one pass over the sorted pieces hashes them, as SHA-256 only runs
in order; it holds one piece at a time.

Defined results: a null role or text is one blank (its initial is a blank, its text blank);
null turns come first; rows of one turn follow each other by role, then text; a null
conversation id is a conversation like others. Rows that are equal in all four are repeats. Conversations whose rows
are all dropped give zeros, an empty audit and the hash of the empty string. Initials
are compared as they stand ('User' starts with no known initial, so such a row is given another role or deleted). Other columns
aren't read. An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import attach, table
from .shared import scratch, stage

SEGMENT, AT_ONCE = 2_000, 2_000_000
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# the grammar: state -> initial -> state; START and A accept
START, S, U, A = range(4)
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
ACCEPTS = (START, A)
FULL = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
FRESH, BLANK, DUPLICATE, CUT = range(4)
SPACE = r"[\x20\x09-\x0D]"

Row = tuple[str, int]  # initial, fault
Way = tuple[int, str]  # cost, audit


def steps(state: int, row: Row | None) -> Iterator[tuple[str, int, int, int]]:
    """(edit, rows read, cost, state) that a node allows."""
    for initial, then in NEXT[state].items():
        if initial in FULL:
            yield "I", 0, INSERT, then
    if row is not None:
        initial, fault = row
        yield "D", 1, DELETE, state
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            if initial in NEXT[state]:
                yield "K", 1, extra, NEXT[state][initial]
            for other, then in NEXT[state].items():
                if other in FULL:
                    yield "R", 1, RELABEL + extra, then


def search(rows: list[Row], start: int, ends: tuple[int, ...], first_only: bool) -> dict[int, Way]:
    """Cheapest (cost, audit) from a state before the rows to states behind them: the first popped of ends, or all of them."""
    found: dict[int, Way] = {}
    done: set[tuple[int, int]] = set()
    known: dict[tuple[int, int], Way] = {(0, start): (0, "")}
    queue: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ends:
            found[state] = (cost, audit)
            if first_only or len(found) == len(ends):
                break
        for edit, read, price, then in steps(state, rows[at] if at < len(rows) else None):
            node, way = (at + read, then), (cost + price, audit + edit)
            if node not in done and way < known.get(node, (1 << 62, "")):
                known[node] = way
                heapq.heappush(queue, (*way, *node))
    return found


def edited(rows: list[tuple[str, str, str, int]], audit: str, state: int) -> Iterator[str]:
    """The repaired lines of rows (initial, role, text, fault) under an audit that starts in a state."""
    at = 0
    for edit in audit:
        if edit == "I":
            initial = next(i for i in NEXT[state] if i in FULL)
            yield f"{FULL[initial]}:"
        else:
            initial, role, text, _ = rows[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                initial = next(i for i in NEXT[state] if i in FULL)
                role = FULL[initial]
            yield f"{role}:{text}"
        state = NEXT[state][initial]


def damaged(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copies: the contract's faults, by crc32 of `conversation:turn`; dropped rows have no copies."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conversation), F.lit(":"), shown(turn))) % 20
    return df.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.when(kind == 0, F.lit("")).when(kind == 4, F.lit("user")).otherwise(shown(role)).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """One row for each different (conv, turn, role, text) with its copies and the fault of the first; dropped rows are kept, with no copies."""
    rows = stage(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "conversation-rows")
    named = rows.withColumn("digest", F.sha2("text", 256))
    # written first, so that the join has plain exchanges and a crowded key is split
    firsts = stage(named.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")), "first-places")
    firsts = firsts.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    with_first = named.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    seen = ~F.struct(F.col("turn").isNotNull().alias("known"), "turn").eqNullSafe(F.col("first"))
    fault = F.when(blank, BLANK).when(seen, DUPLICATE).when(cut, CUT).otherwise(FRESH)
    return with_first.select("conv", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


class Segment:
    """Consecutive rows of one conversation; opens: from its first on."""

    def __init__(self, conv: object, opens: bool) -> None:
        self.conv, self.opens, self.rows, self.size = conv, opens, [], 0
        self.turns: list[int] = []
        self.faults = [0, 0, 0, 0]
        self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        if self.rows and self.rows[-1][0] + role[:1] not in LEGAL:
            self.illegal += 1
        # what must go needs no text
        self.rows.append((role[:1], role, "" if fault in (BLANK, DUPLICATE) else text, fault))
        self.faults[fault] += 1
        self.size += len(self.rows[-1][2]) + len(role)

    @property
    def lattice(self) -> list[Row]:
        return [(r[0], r[3]) for r in self.rows]

    def counts(self) -> dict[str, object]:
        return {
            "conv": self.conv, "low": self.turns[0] if self.turns else None,
            "high": self.turns[-1] if self.turns else None,
            "turns": len(self.turns), "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "illegal": self.illegal}


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None or high is None else high - low + 1 - turns


def segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Segment, bool]]:
    """(segment, whether it is a whole conversation) of a task's sorted rows; the first and last conversation may go on in other tasks."""
    held: Segment | None = None
    first = True
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for conv, turn, role, text, copies, fault in zip(*columns):
            if held is None:
                held = Segment(conv, True)
            elif held.conv != conv:
                yield held, held.opens and not first
                held, first = Segment(conv, True), False
            for n in range(copies):
                if len(held.rows) >= most or held.size >= AT_ONCE:  # a long conversation never waits whole in memory
                    yield held, False
                    held = Segment(conv, False)
                held.add(turn, role, text, fault if not n or fault == BLANK else DUPLICATE)
    if held is not None:
        yield held, False


SUMMARY = ("part long, number long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, size long, head string, tail string, "
           "costs array<array<long>>, audits array<array<string>>, rows array<struct<initial: string, role: string, text: string, fault: int>>, cost long, audit string, hash string")


def summarised(rows: DataFrame, most: int) -> DataFrame:
    """conv and SUMMARY: for a whole conversation cost, audit and hash, for a piece its ways and rows."""
    kind = rows.schema["conv"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size = TaskContext.get().partitionId(), 0, [], 0
        for x, whole in segments(batches, most):
            row = x.counts() | {"part": part, "number": number, "size": len(x.rows)}
            number += 1
            if whole:
                cost, audit = next(iter(search(x.lattice, START, ACCEPTS, True).values()))
                row |= {"cost": cost, "audit": audit, "hash": hashlib.sha256("\n".join(edited(x.rows, audit, START)).encode()).hexdigest()}
            else:
                ways = [search(x.lattice, s, (START, S, U, A), False) for s in range(4)]
                row |= {
                    "head": x.rows[0][0] if x.rows else None, "tail": x.rows[-1][0] if x.rows else None,
                    "costs": [[w[t][0] if t in w else None for t in range(4)] for w in ways], "audits": [[w[t][1] if t in w else None for t in range(4)] for w in ways],
                    "rows": [dict(zip(("initial", "role", "text", "fault"), r)) for r in x.rows]}
            out.append(row)
            size += x.size if not whole else 200
            if size >= AT_ONCE or len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, shape)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, shape)

    schema = f"conv {kind}, {SUMMARY}"
    shape = to_arrow_schema(T.StructType.fromDDL(schema))
    return rows.mapInArrow(kernel, schema)


def composed(pieces: DataFrame) -> DataFrame:
    """conv, part, number, state, audit: the way through each piece, and on the first the whole conversation's counts, cost and audit."""
    kind = pieces.schema["conv"].dataType.simpleString()
    out = f"conv {kind}, part long, number long, state int, way string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    shape = to_arrow_schema(T.StructType.fromDDL(out))

    def kernel(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["number"]))
        # ways[t]: cost and the audits of the pieces so far, None where t can't be reached
        ways: list[tuple[int, tuple] | None] = [(0, ()), None, None, None]
        low = high = tail = None
        turns = illegal = 0
        for n, r in enumerate(rows):
            after: list[tuple[int, tuple] | None] = [None] * 4
            for t in range(4):
                options = [(ways[s][0] + r["costs"][s][t], s) for s in range(4) if ways[s] is not None and r["costs"][s][t] is not None]
                if options:
                    least = min(c for c, _ in options)
                    tied = [(ways[s][1], s) for c, s in options if c == least]
                    chosen = tied[0] if len(tied) == 1 else min(tied, key=lambda x: walked(x[0]) + r["audits"][x[1]][t])
                    after[t] = (least, (chosen[0], chosen[1], r["audits"][chosen[1]][t]))
            ways = after
            illegal += r["illegal"] + (tail is not None and r["head"] is not None and tail + r["head"] not in LEGAL)
            tail = r["tail"] if r["tail"] is not None else tail
            if r["low"] is not None:
                turns += r["turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
        cost, path = min((ways[t] for t in ACCEPTS if ways[t] is not None), key=lambda w: (w[0], walked(w[1])))
        steps_back = []
        while path:
            path, state, audit = path
            steps_back.append((state, audit))
        steps_back.reverse()
        made = []
        for r, (state, audit) in zip(rows, steps_back):
            made.append({"conv": r["conv"], "part": r["part"], "number": r["number"], "state": state, "way": audit})
        made[0] |= {
            "gaps": gaps(low, high, turns), "illegal": illegal, "cost": cost, "audit": "".join(a for _, a in steps_back),
            **{k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}}
        return pa.Table.from_pylist(made, shape)

    facts = ["conv", "part", "number", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail", "costs", "audits"]
    return pieces.select(*facts).groupBy("conv").applyInArrow(kernel, out)


def walked(path: tuple) -> str:
    """The audit of a path of pieces."""
    found = []
    while path:
        path, _, audit = path
        found.append(audit)
    return "".join(reversed(found))


def hashed(lines: DataFrame) -> DataFrame:
    """conv, hash of the lines (conv, part, number, rows, state, way), in order, one piece at a time."""
    kind = lines.schema["conv"].dataType.simpleString()

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = [(r["initial"], r["role"], r["text"], r["fault"]) for r in b.column(3)[i].as_py()]
                text = "\n".join(edited(rows, b.column(5)[i].as_py(), b.column(4)[i].as_py()))
                # whether it holds a line at all: an empty piece has no line, not an empty one
                some = any(e != "D" for e in b.column(5)[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), b.column(2).slice(i, 1), pa.array([text if some else None], pa.string())], ["conv", "part", "number", "text"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, some, started = None, hashlib.sha256(), False, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], own), pa.array([digest.hexdigest()])], ["conv", "hash"])

        for b in batches:
            own = b.schema.field(0).type
            for name, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if not started or name != conv:
                    if started:
                        yield done()
                    conv, digest, some, started = name, hashlib.sha256(), False, True
                if text is not None:
                    digest.update(("\n" if some else "").encode() + text.encode())
                    some = True
        if started:
            yield done()

    pieces = lines.select("conv", "part", "number", "rows", "state", "way").mapInArrow(repaired, f"conv {kind}, part long, number long, text string")
    order = pieces.repartition("conv").sortWithinPartitions("conv", "part", "number")
    return order.mapInArrow(kernel, f"conv {kind}, hash string")


def repaired(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows (conv, turn, role, text, copies), read in segments of at most so many."""
    place = ["conv", "turn", "role", "text"]
    with scratch() as keep:
        ordered = faults(rows).repartitionByRange(*place).sortWithinPartitions(*place)
        made = stage(summarised(ordered, most), "segments")
        gap = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
        counts = ["blank", "duplicate", "truncated", "illegal"]
        whole = made.where("hash IS NOT NULL").select("conv", gap.alias("gaps"), *counts, "cost", "audit", "hash")
        pieces = made.where("hash IS NULL")
        ways = stage(composed(pieces), "ways")
        parts = pieces.select("part", "number", "conv", "rows").join(ways.select("part", "number", "state", "way"), ["part", "number"])
        digests = hashed(parts).withColumnRenamed("conv", "c")
        long = ways.where("cost IS NOT NULL").join(digests, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "gaps", *counts, "cost", "audit", "hash")
        return keep(whole.unionByName(long).withColumnsRenamed({"conv": "conv_id", "hash": "repaired_sha256"}), "repaired")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says, then repaired."""
    attach(spark)
    return repaired(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op13_repair": op13_repair}
ORACLE_SQL: dict[str, str] = {}
