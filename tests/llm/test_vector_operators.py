import math

import numpy as np
import pytest

from quillspark.llm import neardup, topk, urls
from tests.conftest import DATA


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int, rank string")


def full(rows):
    return [(i, v, y, 1, "x") for i, v, y in rows]


ODD = [(900, None, 1), (901, [], 1), (902, [None, 1.0], 1), (903, [float("nan"), 1.0], 1), (904, [float("inf"), 1.0], 1), (905, [0.0, 0.0], 1)]


def test_top_k_equals_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).round(1).tolist() if i % 3 else [0.5, 0.0, 0.0, 1.0, -0.25], i % 2) for i in range(250)]
    rows += [(100, rows[1][1], 0), (300, [1.0, 2.0], 0), (400, [], 0)] + ODD
    vectors(spark, full(rows)).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(topk, "LANE_BLOCKS", 1)
    got = sorted(tuple(r) for r in topk.op8_topk(spark, str(tmp_path)).collect())
    sound = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in sound:  # an id that repeats has a list for each row
        if q % 100 == 0:
            best = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q), key=lambda x: (-x[0], x[1]))[:10]
            want += [(q, k, i, x) for k, (x, i) in enumerate(best, 1)]
    assert got == sorted(want) and sum(q == 100 for q, *_ in got) == 20


def test_top_k_of_few_and_none(spark):
    q = spark.createDataFrame([(0, [1]), (1, [2])], "vec_id long, q array<long>")
    assert [tuple(r) for r in topk.top_k(q.where("vec_id = 0"), q).collect()] == [(0, 1, 1, 2)]
    assert topk.top_k(q.limit(0), q).count() == 0
    assert topk.top_k(q, q.limit(0)).count() == 0


def links(rows, bound=0.93):
    sound = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, count = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a, y) in enumerate(sound):
        for j, b, z in sound[n + 1 :]:
            if y == z and len(a) == len(b) and a @ b / math.sqrt(a @ a * (b @ b)) >= bound:
                count[i] += 1
                count[j] += 1
                x, w = root(i), root(j)
                parent[max(x, w)] = min(x, w)
    return {i: (count[i], root(i)) for i in parent}


@pytest.mark.parametrize("chunk", [4, 1024])
def test_near_duplicates_recall(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        c = rng.standard_normal(16)
        rows += [(len(rows) + k, (c + rng.standard_normal(16) * 0.1).astype("float32").tolist(), g % 3) for k in range(int(rng.integers(1, 8)))]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), *ODD]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(vectors(spark, full(rows))).collect()}
    want = links(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    for i in (502, *(x[0] for x in ODD)):
        assert got[i] == (0, i)


def test_near_duplicates_recall_at_the_bound(spark):
    """64 dimensions, pairs planted with cosines from 0.93 to 0.94, all of one label: the share of links found, link by link."""
    rng = np.random.default_rng(11)
    n, rows = 1500, []
    for g in range(n):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9302, 0.94)
        rows += [(2 * g, a.tolist(), 1), (2 * g + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    found = sum(got[2 * g + 1] == (1, 2 * g) for g in range(n))
    assert found >= 0.95 * n
    assert all(got[i] in ((0, i), (1, i - i % 2)) for i in got)


def test_near_duplicates_of_one_id_with_two_vectors(spark):
    df = vectors(spark, full([(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (0, [0.0, 1.0], 5)]))
    assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == [(0, 1, 0, True), (1, 0, 1, True), (1, 1, 0, False)]


def test_near_duplicates_of_repeats_and_none(spark):
    df = vectors(spark, full([(1, [1.0, 0.0], 5), (2, [0.0, 1.0], 5)]))
    got = sorted(tuple(r) for r in neardup.near_duplicates(df.union(df)).collect())
    assert got == [(1, 1, 1, True)] * 2 + [(2, 1, 2, True)] * 2
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_tables_reach_the_stated_recall():
    for n in (10, 10**4, 10**8, 10**11):
        bits, tables = neardup.shape(n)
        p = (1 - math.acos(0.93) / math.pi) ** bits
        assert 1 - (1 - p) ** tables >= neardup.RECALL - 1e-9


URLS = [None, "", "no scheme/com/en/", "http://", "http://COM/en/x", "https://a.com/en/", "http://xcom/en/", "http://example.com/en/77?q", "http://b.example.com/en/6", "http://x.net/de/1", "http://example.net/de/81#f",
        "http://example.net/de/9", "http://o.org/es/", "http://o.org/es", "http://o.org?x=/es/", "http://o.org:80/es/", "http://o.com/en//../", "http://" + "a." * 500 + "com/en/" + "z" * 5000, "x://É.com/en/"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    while rest and rest[0] not in "/?#":
        host, rest = host + rest[0], rest[1:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = ""
    while rest and rest[0] not in "?#":
        path, rest = path + rest[0], rest[1:]
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "rule", "v") for i, u in enumerate(URLS)] + [(4, URLS[4], "r", "v")], "page_id long, url string, rule string, verdict string")
    got = urls.filter_urls(df, urls.contract_rules(spark)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(URLS[r["page_id"]])
    assert urls.filter_urls(df.limit(0), urls.contract_rules(spark)).count() == 0
    none = urls.filter_urls(df, urls.contract_rules(spark).limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


def test_url_rules_of_ten_thousand_shapes(spark, monkeypatch):
    """Rules of all lengths, broken and repeated ones among them; the same when they are too many for a broadcast."""
    rules = [("block", f"{'a.' * (i % 4)}site{i % 50}.com", "/" + "x" * (i // 200)) for i in range(10_000)]
    rules += [("allow", *rules[7][1:]), (None, "site1.com", "/"), ("allow", "", "/"), ("allow", None, "/"), ("allow", "site1.com", None), ("allow", "site3.com", "")]
    df = spark.createDataFrame([(i, f"http://{'a.' * (i % 6)}site{i % 60}.com/{'x' * (i % 70)}y") for i in range(300)], "page_id long, url string")
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    usable = [(v, h, p) for v, h, p in rules if v and h and p is not None]

    def best(url):
        host, path = url[7:].split("/", 1)
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in usable if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fit)[2:] if fit else (None, "allow")

    expected = {i: best(u) for i, u in df.collect()}
    assert {(r["rule"] is None) for r in urls.filter_urls(df, frame).collect()} == {True, False}
    for bound in (urls.BROADCAST_RULES, 10):
        monkeypatch.setattr(urls, "BROADCAST_RULES", bound)
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, frame).collect()} == expected


def test_url_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in urls.op7_urls(spark, DATA).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(pages[r["page_id"]])
