import hashlib
import re

import numpy as np
import pytest

from quillspark.llm import decontam as dc
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for size in {len(k) for k in wins}:
            for k in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    named |= own
        ids = sorted(str(i) for i in named if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (2, "short ITEM"), (10, "a a a a a a a a a a a a"), (3, ""), (4, None), (5, "--- !!"),
         (None, "nameless words here"), (6, "Überall größer größer ABC é"), (7, "two three four five six seven eight nine ten eleven twelve"), (9, "short")]
DOCS = [(1, "x ONE, two-three four\nfive six seven eight nine ten ELEVEN twelve y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "shorts item short itemx"),
        (6, "short item"), (6, "short\x00item"), (7, "a " * 300), (8, "überall größer größer abc é"), (9, "Überall größer GRÖßER abc é nameless words here"), (10, "filler " * 200_000 + "short item"),
        (None, "short item"), (11, "日本 short item short item"), (12, "one two three four five six seven eight nine ten two three four five six seven eight nine ten eleven twelve")]


def frames(spark, docs=DOCS, items=ITEMS):
    return (spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id long, text string, found string, part int"),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("shard", [dc.SHARD, 60])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(dc, "SHARD", shard)
    docs, items = frames(spark)
    got = sorted((tuple(r) for r in dc.contaminated(docs, items).collect()), key=str)
    assert got == expected(DOCS, ITEMS)


def test_random_texts_equal_brute_force(spark, monkeypatch):
    """Few words, so that windows overlap, repeat and lie inside each other, over several shards."""
    monkeypatch.setattr(dc, "SHARD", 400)
    rng = np.random.default_rng(5)
    line = lambda n: " ".join(rng.choice(["a", "b", "aa", "ab"], n, p=[.7, .1, .1, .1]))
    items = [(i, line(int(rng.integers(1, 25)))) for i in range(40)]
    docs = [(i, line(int(rng.integers(0, 300)))) for i in range(60)] + [(1, "")]
    got = sorted((tuple(r) for r in dc.contaminated(*frames(spark, docs, items)).collect()), key=str)
    assert got == expected(docs, items)


@pytest.mark.parametrize("shard", [dc.SHARD, 60])
def test_spans_are_those_of_the_original(spark, monkeypatch, shard):
    monkeypatch.setattr(dc, "SHARD", shard)
    docs, items = frames(spark)
    got = {(r["doc_id"], r["text"]): r["hits"] for r in dc.spans(docs, items, name="hits").collect()}
    for (_, text), hits in got.items():
        for (a, z), span in zip(hits["words"], hits["spans"]):
            assert words(text[span["start"] : span["end"]]) == words(text)[a:z]
    one = got[(1, DOCS[0][1])]
    assert [DOCS[0][1][s["start"] : s["end"]] for s in one["spans"]] == [DOCS[0][1][2:-2]]
    assert [("日本 short item short item")[s["start"] : s["end"]] for s in got[(11, DOCS[-2][1])]["spans"]] == ["short item"]


def test_no_items_and_no_documents(spark):
    docs, items = frames(spark)
    assert {(r["n_hit"], r["n_items"], r["contaminated"]) for r in dc.contaminated(docs, items.limit(0)).collect()} == {(0, 0, False)}
    assert dc.contaminated(docs.limit(0), items).count() == 0


def test_query_equals_brute_force(spark):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(key, "text").collect()]
    got = sorted((tuple(r) for r in dc.op11_decontam(spark, DATA).collect()), key=str)
    assert got == expected(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert any(r[-1] for r in got)
