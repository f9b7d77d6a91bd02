import time

import numpy as np
import pytest

from quillspark.operators import components, density, vectors

SETTINGS = [(m, c, s) for m in ("eom", "leaf") for c, s in ((5, 3), (12, 5), (4, 1))]


def points(seed=3):
    """Groups of different density, noise, and points that lie on one another."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.2, (n, 3)) for c, n in ((0, 150), (2, 90), (4, 60), (1, 7))] + [rng.uniform(-2, 6, (60, 3))])
    x[5] = x[6] = x[7]
    x[200:204] = x[200]
    return x, rng.permutation(len(x)) * 3 + 1


@pytest.mark.parametrize("block, local, band", [(1024, density.LOCAL, density.BAND), (40, 200, density.BAND), (40, density.LOCAL, 60)])
def test_tables_give_the_labels_of_one_matrix(spark, monkeypatch, block, local, band):
    """One block and one task; many blocks and rounds of least edges; many bands of the tree."""
    monkeypatch.setattr(density, "BLOCK", block)
    x, ids = points()
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")
    got = density.clusterings(df, SETTINGS, band=band, local=local).toPandas()
    order = np.argsort(ids)
    for m, c, s in SETTINGS:
        own = got[(got.method == m) & (got.min_cluster_size == c) & (got.min_samples == s)].sort_values("id")
        want = density.density_labels(x[order], c, s, m)
        assert (own.cluster_id.to_numpy() == want).all() and want.max() > 0 and (want < 0).any()


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1.0])], "id long, v array<double>")
    for n in (0, 1, 2, 3):
        got = density.clusterings(df.limit(n), [("eom", 2, 1), ("leaf", 5, 3)]).collect()
        assert len(got) == 2 * n and {r["cluster_id"] for r in got} <= {-1}


def test_copies_are_compared_once(spark, monkeypatch):
    """equal vectors meet as one, core distances count them, and rows that hold no number are noise."""
    met, dealt = [], density.blocks
    monkeypatch.setattr(density, "blocks", lambda rows, n: met.append((rows.count(), n)) or dealt(rows, n))
    rng = np.random.default_rng(5)
    x = np.repeat(np.concatenate([rng.normal(c, 0.2, (n, 3)) for c, n in ((0, 30), (3, 20))] + [rng.uniform(-2, 6, (10, 3))]), rng.integers(1, 9, 60), axis=0)
    ids = rng.permutation(len(x)) * 2
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(1, [0.0, float("nan"), 0.0]), (3, [0.0, None, 0.0])]
    got = density.clusterings(spark.createDataFrame(rows, "id long, v array<double>"), SETTINGS).toPandas()
    assert met == [(60, 60)] and (got[got.id.isin([1, 3])].cluster_id == -1).all()
    for m, c, s in SETTINGS:
        own = got[(got.method == m) & (got.min_cluster_size == c) & (got.min_samples == s) & (got.id % 2 == 0)].sort_values("id")
        assert (own.cluster_id.to_numpy() == density.density_labels(x[np.argsort(ids)], c, s, m)).all()


@pytest.mark.parametrize("local", [density.LOCAL, 100])
def test_later_searches_are_of_few_rows(spark, monkeypatch, local):
    """after the first search only rows of components that may have an unknown least edge meet all others; the largest has none."""
    asked, search = [], density.nearest
    monkeypatch.setattr(density, "nearest", lambda rows, most, layers: asked.append("wanted" in rows.columns and sum(np.frombuffer(w, bool).sum() for r in rows.collect() for w in r["wanted"])) or search(rows, most, layers))
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, (n, 4)) for c, n in ((0, 200), (5, 60), (9, 50), (30, 40))] + [rng.uniform(-2, 12, (30, 4))])
    got = density.clusterings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), [("eom", 8, 4), ("leaf", 12, 6)], local=local).toPandas()
    assert len(asked) > 1 and not asked[0] and all(0 < n <= 2 * 180 for n in asked[1:])
    for m, c, s in (("eom", 8, 4), ("leaf", 12, 6)):
        own = got[(got.method == m) & (got.min_cluster_size == c)].sort_values("id").cluster_id.to_numpy()
        assert (own == density.density_labels(x, c, s, m)).all() and own.max() >= 3


def test_planted_groups_in_fifty_thousand_vectors(spark):
    """No other algorithm takes over: 12 groups and thinly spread points, all groups found, the spread ones noise."""
    rng = np.random.default_rng(8)
    centres = rng.uniform(-20, 20, (12, 6))
    group = rng.integers(0, 12, 47_000)
    x = np.concatenate([centres[group] + rng.normal(0, 0.3, (47_000, 6)), rng.uniform(-30, 30, (3_000, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(16)
    began = time.time()
    got = density.clusterings(df, [("eom", 200, 10)]).toPandas().sort_values("id").cluster_id.to_numpy()
    print(f"{time.time() - began:.0f} s")
    assert len(set(got) - {-1}) == 12
    for g in range(12):
        own = got[:47_000][group == g]
        names, n = np.unique(own[own >= 0], return_counts=True)
        assert len(names) == 1 and n[0] > 0.97 * len(own)
    assert (got[47_000:] < 0).mean() > 0.95


def test_selection_is_the_same_by_either_path(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = [c + rng.normal(0, 0.02, 8) for c in np.eye(8)[:3] for _ in range(9)] + [rng.uniform(-1, 1, 8) for _ in range(5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    one = {r["id"]: (r["cluster_id"], r["pass"]) for r in vectors.selected(df).collect()}
    monkeypatch.setattr(vectors, "LARGEST", 10)
    monkeypatch.setattr(vectors, "TIERS", [(None, (4, 5), (2, 3))])
    assert {r["id"]: r["cluster_id"] for r in vectors.selected(df).collect()} == {i: c for i, (c, _) in one.items()}


@pytest.mark.parametrize("slice_of, share", [(50_000, 32_768), (30, 3)])
def test_all_settings_are_graded_at_once(spark, monkeypatch, slice_of, share):
    """the metrics of every setting as metrics() has them one by one; a setting may leave noise alone, a cluster may be one row."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((90, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    settings = [("eom", 5, 3), ("leaf", 5, 3), ("eom", 8, 3), ("eom", 9, 3), ("leaf", 9, 3)]
    labels = [rng.integers(-1, 6, 90), np.full(90, -1), np.r_[0, rng.integers(1, 3, 89)], np.full(90, 0), np.arange(90) - 1]
    found = spark.createDataFrame([(*k, i, int(c)) for k, own in zip(settings, labels) for i, c in enumerate(own)], f"{vectors.SETTING}, id long, cluster_id int")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(vectors, "SLICE", slice_of)
    monkeypatch.setattr(vectors, "SHARE", share)
    monkeypatch.setattr(vectors, "metrics", None)
    got = {(r["method"], r["min_cluster_size"], r["min_samples"]): r for r in vectors.grades(found, rows, settings, 90).collect()}
    monkeypatch.undo()
    assert set(got) == set(settings)
    for k, own in zip(settings, labels):
        want = vectors.metrics(spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(own, x))], "id long, cluster_id int, v array<double>")).fillna(0).first()
        for name in ("clusters", "noise", "largest", "smallest", "silhouette", "intra", "inter", "entropy", "noise_share", "largest_share", "score"):
            assert got[k][name] == pytest.approx(want[name], abs=1e-9), (k, name)


@pytest.mark.parametrize("local", [0, 10, 500_000])
def test_components(spark, local):
    rng = np.random.default_rng(local)
    edges = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))] + [(5, 5)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["seq"]: r["group"] for r in components.groups(spark.createDataFrame(edges, "canonical long, duplicate long"), local).collect()}
    assert got == {v: root(v) for v in parent}


def test_components_of_no_edges(spark):
    assert components.groups(spark.createDataFrame([], "canonical long, duplicate long")).count() == 0


def test_sums_fold_to_the_same_silhouette_and_ends(spark):
    """Representatives of a large cluster are its ends; of a small one all."""
    rows = [(0, i, [float(np.cos(i / 100)), float(np.sin(i / 100))]) for i in range(40)] + [(1, 100 + i, [0.0, 1.0]) for i in range(3)]
    got = {}
    for r in vectors.representatives(spark.createDataFrame(rows, "cluster_id int, id long, v array<double>")).collect():
        got.setdefault((r["cluster_id"], r["kind"]), set()).add(r["id"])
    c = np.array([v for k, _, v in rows if k == 0])
    near = sorted(range(40), key=lambda i: (-(c[i] @ c.mean(axis=0)), i))
    assert got == {(0, "central"): set(near[:6]), (0, "diverse"): set(near[-2:]), (1, "central"): {100, 101, 102}}
