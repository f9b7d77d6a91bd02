import math

import numpy as np
import pytest

from quillspark.llm import negatives as ng
from tests.conftest import DATA

ODD = [(900, None, 1), (950, [], 1), (902, [None, 1.0], 1), (903, [float("nan"), 1.0], 1), (904, [float("inf"), 1.0], 1), (905, [0.0, 0.0], 1), (906, [1.0, 0.5, 0.5], None), (None, [1.0, 0.0], 1)]


def expected(rows):
    sound = []
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, y, q in sound:
        if a % 50:
            continue
        score = lambda w: sum(s * t for s, t in zip(q, w))
        near = sorted((-score(w), i) for i, z, w in sound if i != a and z == y)[:5]
        for s, p in near:
            fit = sorted((-score(w), i) for i, z, w in sound if i != a and z != y and 50 * -s <= 100 * score(w) <= 95 * -s)[:3]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, v, y, 1.0, "x") for i, v, y in rows], "vec_id long, embedding array<float>, label int, score double, q string")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in ng.op12_negatives(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("numbers", [64, ng.NUMBERS])
def test_equals_brute_force(spark, monkeypatch, tmp_path, numbers):
    """Small blocks too, so that a grid of many cells meets; ties, repeated rows and ids, odd rows."""
    monkeypatch.setattr(ng, "NUMBERS", numbers)
    monkeypatch.setattr(ng, "LANE_BLOCKS", 1)
    rng = np.random.default_rng(numbers)
    rows = [(i, rng.integers(0, 4, 6).astype(float).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [rows[50], (100, rows[3][1], 2), (7, rows[8][1], 0), (150, [1.0, 2.0], 1), (1000, [3.0, 1.0, 0.5], 1), *ODD]
    got = mined(spark, rows, tmp_path)
    assert got == expected(rows) and len(got) > 50


def test_clustered_vectors_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((8, 24)) * 2
    rows = [(i, (centres[i % 8] + rng.standard_normal(24) * 0.4).astype("float32").tolist(), i % 3) for i in range(900)]
    got = mined(spark, rows, tmp_path)
    assert got == expected(rows) and got


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in ng.op12_negatives(spark, DATA).collect()) == expected(rows)


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(50, 1, [5, 5])], "vec_id long, label long, q array<long>")
    assert ng.hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert ng.hard_negatives(df, df).count() == 0


def test_brackets_hold_and_prune():
    """For clusters far apart the pivot table settles most rows without a score; a bracket always holds it."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 32))
    own = np.floor(256 * (centres[np.arange(3000) % 6] + 0.05 * rng.standard_normal((3000, 32)))).astype(np.int64)
    largest = float(ng.squares(own).max())
    pivots = ng.apart(own[:500], largest, ng.PIVOTS)
    parts = {"ids": np.arange(3000), "labels": np.arange(3000) % 6, "vectors": own, "distances": ng.to_pivots(ng.augmented(own, largest), pivots)}
    cell = ng.Cell(parts, 32, largest)
    for a in range(0, 60, 7):
        anchor = own[a : a + 1]
        to = ng.to_pivots(np.hstack([anchor.astype(float), [[0.0]]]), pivots)[0]
        least, most = cell.bounds(ng.squares(anchor)[0], to)
        scores = ng.products(own, anchor)[:, 0]
        assert (least <= scores).all() and (scores <= most).all()
        low, high = cell.outer(ng.squares(anchor)[0], to)
        assert low <= scores.min() and scores.max() <= high
        assert (most >= scores[parts["labels"] == a % 6].min()).mean() < 0.6


def test_scores_beyond_doubles_are_whole():
    big = np.array([[2**40 + 1, 3], [2**20 + 7, -5]])
    assert ng.products(big[1:], big[1:])[0, 0] == (2**20 + 7) ** 2 + 25
    huge = np.array([[2**30 + 1, 1]])
    assert ng.products(huge, huge)[0, 0] == (2**30 + 1) ** 2 + 1
