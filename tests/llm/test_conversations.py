import hashlib
import itertools
import re
import zlib

import pytest

from quillspark.llm import conversations as cv
from tests.conftest import DATA

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def broken(rows):
    """The contract's faults on rows (conv, turn, role, text), row by row."""
    out = []
    for c, t, r, x in rows:
        shown = [" " if v is None else str(v) for v in (c, t, r, x)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", shown[3]) if kind == 2 else shown[3]
        out += [(c, t, "user" if kind == 4 else shown[2], text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2], v[3]))


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, kinds):
    """(cost, audit) by relaxing whole levels row by row, all ways to a state compared: no search order, no early end."""
    def grown(level):
        for _ in range(4):
            for state, (cost, audit) in list(level.items()):
                for i in "ua":
                    then = follow(state, i)
                    if then is not None:
                        level[then] = min(level.get(then, (10**9, "")), (cost + 3, audit + "I"))
        return level

    def follow(state, i):  # the state is the end of the initials so far
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, i))

    level = grown({"": (0, "")})
    for (_, _, role, _), kind in zip(rows, kinds):
        after = {}
        for state, (cost, audit) in level.items():
            ways = [(state, cost + 4, "D")]
            if kind not in ("blank", "duplicate"):
                more = 3 if kind == "truncated" else 0
                ways += [(follow(state, role[:1]), cost + more, "K")] + [(follow(state, i), cost + 3 + more, "R") for i in "ua"]
            for then, price, edit in ways:
                if then is not None:
                    after[then] = min(after.get(then, (10**9, "")), (price, audit + edit))
        level = grown(after)
    return min(level[s] for s in ("", "a") if s in level)


def replay(rows, audit):
    lines, initials, rest = [], "", iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = ("assistant" if initials.endswith("u") else "user"), ""
        else:
            _, _, role, text = next(rest)
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if initials.endswith("u") else "user"
        initials += role[:1]
        lines.append(f"{role}:{text}")
    assert GRAMMAR.match(initials) and next(rest, None) is None
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = broken([r for r in rows if r[0] == conv])
        kinds = faults(own)
        turns = [t for _, t, _, _ in own if t is not None]
        cost, audit = cheapest(own, kinds)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, replay(own, audit))
    return out


def found(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, fault string")


def random_rows(rng, convs, most):
    texts = ["Fine.", "cut off", "", " \t", "What?", "a!\n", "Überall.", None]
    return [(c, None if rng.random() < 0.05 else t * int(rng.integers(1, 3)), rng.choice(["user", "assistant", "system", "tool", "", None], p=[.4, .35, .1, .05, .05, .05]), texts[rng.integers(len(texts))])
            for c in range(convs) for t in range(int(rng.integers(1, most)))]


@pytest.mark.parametrize("segment", [3, 2_000])
def test_repair_equals_brute_force(spark, segment):
    import numpy as np

    rng = np.random.default_rng(segment)
    rows = random_rows(rng, 120, 14)
    rows += [(None, 1, "user", "x."), (None, None, None, None), (500, None, "user", "y."), (500, None, "user", "y.")]
    rows += rows[:40]  # repeated rows
    got = found(cv.repaired(cv.damaged(frame(spark, rows).repartition(5)), segment))
    assert got == expected(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(cv.op13_repair(spark, DATA)) == expected(rows)


def test_one_long_conversation_is_cut(spark):
    rows = [(7, t, ("user", "assistant", "user")[t % 3], f"line {t}{'.' if t % 5 else ''}") for t in range(700)] + [(8, 1, "user", "z" * 3_000_000 + ".")]
    df = cv.repaired(cv.damaged(frame(spark, rows)), 16)
    assert found(df) == expected(rows)


def test_many_copies_of_one_row(spark):
    rows = [(1, 2, "user", "same.")] * 400 + [(1, 4, "assistant", "Yes.")] + [(2, 5, "user", "")] * 300
    assert found(cv.repaired(cv.damaged(frame(spark, rows)), 50)) == expected(rows)


def test_empty_table(spark):
    assert cv.repaired(cv.damaged(frame(spark, [(1, 1, "user", "a")]).limit(0))).count() == 0


def test_conversation_that_is_dropped_whole(spark):
    gone = next(t for t in range(200) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = found(cv.repaired(cv.damaged(frame(spark, [(3, gone, "user", "a.")]))))
    assert got == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_search_finds_the_least_of_all_audits():
    """Every audit of up to four rows and two more inserts, enumerated."""
    def worth(rows, audit):
        state, cost, at = cv.START, 0, 0
        for e in audit:
            if e != "I" and at == len(rows):
                return None
            way = [w for w in cv.steps(state, rows[at] if at < len(rows) else None) if w[0] == e]
            if not way:
                return None
            _, read, price, state = way[0]
            at, cost = at + read, cost + price
        return cost if at == len(rows) and state in cv.ACCEPTS else None

    for rows in itertools.product([("u", 0), ("a", 0), ("s", 0), ("a", 3), ("u", 2)], repeat=3):
        every = (("".join(a)) for n in range(len(rows), len(rows) + 3) for a in itertools.product("DIKR", repeat=n))
        best = min((worth(rows, a), a) for a in every if worth(rows, a) is not None)
        assert next(iter(cv.search(list(rows), cv.START, cv.ACCEPTS, True).values())) == best
