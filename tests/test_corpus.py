import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import caching, filling, ranking, reduction, resolve, sketches, vocabulary
from quillspark.plans import analysis_queries, corpus_queries
from quillspark.session import folders
from quillspark.sources import readers
from quillspark.streaming import totals
from tests.conftest import DATA


def chosen(rows, k, taken=(), trade=0.6):
    """Maximal marginal relevance in a plain loop over rows (id, score, v)."""
    size = lambda v: np.array(v) / np.linalg.norm(v) if np.linalg.norm(v) else np.array(v) * 0.0
    known, left = [size(v) for _, _, v in taken], {i: (s, size(v)) for i, s, v in rows}
    scores = [s for _, s, _ in [*rows, *taken]]
    low, high, made = min(scores), max(scores), []
    while left and len(made) < k:
        def value(i):
            s, v = left[i]
            rel = (s - low) / (high - low) if high > low else 1.0
            return trade * rel - (1 - trade) * max((float((v * o).sum()) for o in known), default=0.0)
        best = min(left, key=lambda i: (-round(value(i), 12), -left[i][0], i))
        made.append(best)
        known.append(left.pop(best)[1])
    return made


def table_of(spark, rows):
    return spark.createDataFrame([(i, float(s), [float(x) for x in v]) for i, s, v in rows], "id long, score double, v array<double>")


def test_choice_of_many_equals_the_plain_loop(spark):
    """More choices than are compared at once, and rows chosen before."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.random(), rng.standard_normal(6)) for i in range(120)]
    taken = [(1000 + i, rng.random(), rng.standard_normal(6)) for i in range(3)]
    got = [r["id"] for r in ranking.diversified(table_of(spark, rows), 21).orderBy("place").collect()]
    assert got == chosen(rows, 21)
    got = [r["id"] for r in ranking.diversified(table_of(spark, rows), 10, 0.6, table_of(spark, taken)).orderBy("place").collect()]
    assert got == chosen(rows, 10, taken)


def test_sparse_choice_of_the_table(spark):
    rows = [(r["id"], r["score"], r["v"]) for r in corpus_queries.pool(spark, DATA).collect()]
    assert [r["id"] for r in corpus_queries.sparse_mmr(spark, DATA).orderBy("place").collect()] == chosen(rows, 20)


def test_sparse_cosine_equals_the_dense_one(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green the"), (3, ""), (4, None), (5, "yellow")], "id long, text string")
    v = vocabulary.sparse(docs, 3, ["the"]).withColumn("v", vocabulary.dense(F.col("terms"), F.col("weights"), 3))
    got = {r["id"]: r for r in v.collect()}
    assert got[3]["terms"] == got[4]["terms"] == got[5]["terms"] == [] and len(got[1]["terms"]) == 2  # blue, red, green by count and name
    both = v.alias("a").crossJoin(v.alias("b")).select(vocabulary.cosine(*(F.col(f"{s}.{c}") for s in "ab" for c in ("terms", "weights"))).alias("c"), F.col("a.v").alias("x"), F.col("b.v").alias("y")).collect()
    assert all(r["c"] == pytest.approx(float(np.dot(r["x"], r["y"]))) for r in both)


def filled(rows, target, works):
    """The loop in plain Python: (id, round, place, accepted)."""
    left, taken, made, n = list(rows), [], [], 0
    while len(taken) < target and left:
        n += 1
        batch = chosen(left, target - len(taken), taken)
        for place, i in enumerate(batch, 1):
            row = next(r for r in left if r[0] == i)
            made.append((i, n, place, works(i)))
            if works(i):
                taken.append(row)
        left = [r for r in left if r[0] not in batch]
    return sorted(made)


def test_fill_equals_the_plain_loop_and_goes_on_where_it_broke_off(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, round(rng.random(), 6), rng.standard_normal(5)) for i in range(60)]
    works = lambda i: i % 3 == 1
    pool, calls = table_of(spark, rows), []

    def resolve_some(batch):
        calls.append(batch.count())
        if len(calls) == 2:
            raise ConnectionError("the service is down")
        return batch.where("id % 3 <> 2").select("id", (F.col("id") % 3 == 1).alias("accepted"))  # what it says nothing of has failed

    with pytest.raises(ConnectionError):
        filling.fill(pool, 9, resolve_some, f"{tmp_path}/fill")
    assert len(folders(spark, f"{tmp_path}/fill")) == 1
    got = sorted(tuple(r) for r in filling.fill(pool, 9, resolve_some, f"{tmp_path}/fill").collect())
    assert got == filled(rows, 9, works) and sum(a for *_, a in got) == 9
    before = len(calls)
    assert filling.fill(pool, 9, resolve_some, f"{tmp_path}/fill").count() == len(got) and len(calls) == before
    few = filling.fill(pool, 50, lambda b: b.select("id", (F.col("id") % 3 == 1).alias("accepted")), f"{tmp_path}/all").collect()
    assert len(few) == 60 and sum(r["accepted"] for r in few) == 20
    assert filling.fill(pool.limit(0), 5, resolve_some, f"{tmp_path}/none").count() == 0


def test_fill_query_equals_the_plain_loop(spark):
    rows = [(r["id"], r["score"], r["v"]) for r in corpus_queries.pool(spark, DATA).collect()]
    fine = {r["id"] for r in corpus_queries.resolvable(spark.createDataFrame([(r[0],) for r in rows], "id long")).where("accepted").collect()}
    got = sorted(tuple(r) for r in corpus_queries.fill_corpus(spark, DATA).collect())
    assert got == filled(rows, corpus_queries.TARGET, lambda i: i in fine) and max(n for _, n, _, _ in got) > 1


def test_search_rounds_query(spark):
    import re

    got = sorted((r["round"], r["strategy"], r["doc_id"]) for r in corpus_queries.search_rounds(spark, DATA).collect())
    docs = [(r["seq"], r["publication_year"], set(re.split(r"[^\W\d_]+", "")) | set(re.findall(r"[^\W\d_]+", r["abstract"].lower()))) for r in analysis_queries.with_ids(spark, DATA).collect()]
    enough, most = filling.limits(120)
    assert (enough, most) == (180, 100)
    want = []
    for n, part in ((1, corpus_queries.STRATEGIES[:3]), (2, corpus_queries.STRATEGIES[3:])):
        for s in part:
            hits = sorted((-y, i) for i, y, w in docs if set(s.split()) <= w)[:most]
            want += [(n, s, i) for _, i in hits]
    assert got == sorted(want) and got
    first = filling.search_rounds(["a", "b", "c", "d"], lambda s, k: spark.range(40).select(
        F.concat(F.lit(s), F.col("id").cast("string")).alias("paper_id"), F.concat(F.md5(F.concat(F.lit(s), F.col("id").cast("string")))).alias("title"), F.lit("").alias("abstract"), F.lit("A").alias("author"),
        F.lit(2020).alias("publication_year"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.lit("s").alias("source"), F.col("id").alias("place")), 60)
    assert {r["strategy"] for r in first.select("strategy").distinct().collect()} == {"a", "b", "c"}  # 120 records are enough


def test_cache_computes_a_text_once(spark, tmp_path):
    path, rows = f"{tmp_path}/cache", spark.createDataFrame([(1, "red blue"), (2, "red blue"), (3, None), (4, "")], "id long, text string")
    v, n = caching.embedded(rows, "m", caching.hashed_words, path)
    got = {r["id"]: r["v"] for r in v.collect()}
    assert n == 2 and got[1] == got[2] and math.isclose(sum(x * x for x in got[1]), 1) and set(got[3]) == set(got[4]) == {0.0}
    assert caching.embedded(rows, "m", caching.hashed_words, path)[1] == 0
    assert caching.embedded(rows, "other", caching.hashed_words, path)[1] == 2
    more = rows.unionByName(spark.createDataFrame([(5, "green")], "id long, text string"))
    assert caching.embedded(more, "m", caching.hashed_words, path)[1] == 1


def test_a_second_writer_of_the_cache_is_harmless(spark, tmp_path):
    """Another run publishes the same texts while this one computes them."""
    path, rows = f"{tmp_path}/cache", spark.createDataFrame([(1, "red"), (2, "blue")], "id long, text string")

    def slow(texts):
        caching.embedded(rows, "m", caching.hashed_words, path)
        return caching.hashed_words(texts)

    v, n = caching.embedded(rows, "m", slow, path)
    assert n == 2 and v.count() == 2 and len(folders(spark, path)) == 2 and caching.entries(spark, path).count() == 2


def test_reduction_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 20)) * np.linspace(3, 0.1, 20) + 1
    x[7] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    got = np.array([r["v"] for r in reduction.reduced(df).orderBy("id").collect()])
    centred = u - u.mean(axis=0)
    left, sizes, _ = np.linalg.svd(centred, full_matrices=False)
    assert got.shape == (300, 10)
    assert np.allclose(got @ got.T, (left[:, :10] * sizes[:10] ** 2) @ left[:, :10].T, atol=1e-9)  # inner products, whatever the axes' signs
    mean, covariance, n = reduction.moments(df, 20)
    axes, share = reduction.principal(np.cov(u.T, bias=True), 10)
    assert n == 300 and np.allclose(covariance, np.cov(x.T, bias=True)) and np.allclose(share, (sizes**2 / (sizes**2).sum())[:10])
    thin = df.withColumn("v", F.slice("v", 1, 15))
    assert reduction.reduced(thin).exceptAll(thin).count() == 0 and reduction.reduced(df.limit(5)).first()["v"] in x.tolist() and reduction.reduced(df.limit(0)).count() == 0


def test_aliases_equal_the_nested_loop(spark):
    """Thousands of aliases; short names, names within aliases, empty names."""
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcde ") for _ in range(n))
    aliases = [(i, word(r.randint(1, 9)), f"C{i}") for i in range(3000)] + [(5000, "Mixed Case", "M")]
    names = ["", "a", "ab", "  ", "mixed case", "the mixed cases", "zzzz", None] + [word(r.randint(1, 14)) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {x["name"]: x["canonical"] for x in resolve.by_alias(df, spark.createDataFrame(aliases, "ord long, alias string, canonical string")).collect()}
    first = {}
    for o, a, c in aliases:
        first.setdefault(a.lower(), (o, c))
    for n in {x for x in names if x is not None}:
        key = n.strip(" ").lower()
        near = min(((o, c) for a, (o, c) in first.items() if len(a) >= 4 and (a in key or key in a)), default=None)
        assert got[n] == (first[key][1] if key in first else near[1] if near else got[n]), n
    assert [x["name"] for x in resolve.frequent(spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("c", 0)], "name string, seq long"), 2).collect()] == ["a", "c"]


def test_sketches_estimate_and_merge(spark):
    """Sets larger than a sketch: errors stay within the bound that the module states; merged quantiles too."""
    m = spark.range(60_000).select((F.col("id") % 40_000).alias("paper_id"), (F.lit(2020) + F.col("id") % 2).cast("int").alias("year"), (F.col("id") % 7).cast("string").alias("name"))
    m = m.unionByName(m.where("paper_id < 12000").withColumn("year", F.lit(2021)))
    got = sketches.overlaps(sketches.paper_sketches(m)).collect()
    by = {r["year"]: {x["paper_id"] for x in m.where(F.col("year") == r["year"]).select("paper_id").distinct().collect()} for r in m.select("year").distinct().collect()}
    one = next(r for r in got if r["year"] == 2020)
    assert one["papers"] == pytest.approx(len(by[2020]), rel=0.06) and one["next_papers"] == pytest.approx(len(by[2021]), rel=0.06)
    assert one["shared"] == pytest.approx(len(by[2020] & by[2021]), abs=0.06 * len(by[2020] | by[2021]))
    values = spark.range(10_000).select((F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("x"))
    found = {r["q"]: r["value"] for r in sketches.quantiles(sketches.value_sketches(values, "k", "x"), [0.1, 0.5, 0.9]).collect()}
    assert all(abs(v - q * 10_000) < 400 for q, v in found.items())


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """Batches come, are merged, and one that was written before its offsets comes again."""
    keys, path = ["k"], f"{tmp_path}/totals"
    rows = spark.range(90).select((F.col("id") % 4).alias("k"), F.lit(1).cast("long").alias("n"))
    rows.repartition(9).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    totals.accumulate(stream(), path, f"{tmp_path}/progress", keys, ["n"], 4).start().awaitTermination()
    kinds = totals.versions(spark, path)
    assert {n for k, n in kinds if k == "base"} == {3, 7} and len(kinds) == 11
    want = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    now = lambda: {r["k"]: r["n"] for r in totals.current(spark, path, rows.schema, keys, ["n"]).collect()}
    assert now() == want and len(totals.standing(spark, path)) == 2
    (tmp_path / "progress" / "commits" / "8").unlink()
    (tmp_path / "progress" / "commits" / ".8.crc").unlink(missing_ok=True)
    totals.accumulate(stream(), path, f"{tmp_path}/progress", keys, ["n"], 4).start().awaitTermination()
    assert now() == want


def test_readers_pass_over_broken_and_closed_records(spark, tmp_path):
    (tmp_path / "works").mkdir()
    (tmp_path / "works" / "a.json").write_text(
        '{"id": "x/W1", "display_name": "T", "publication_year": 2020, "publication_date": "2020-02-01", "type": "article", "open_access": {"is_oa": true}, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "A B"}}]}\n'
        '{"id": "x/W2", "publication_year": 2020, "type": "article", "open_access": {"is_oa": false}}\n{"id": "x/W3", "publi\n\n'
        '{"id": "x/W4", "display_name": "U", "publication_year": 2020, "publication_date": "2020-03-01", "type": "article", "open_access": {"is_oa": true}}\n'
        '{"id": "x/W5", "display_name": "U", "publication_year": 1990, "type": "article", "open_access": {"is_oa": true}}\n')
    rows = readers.works(spark, str(tmp_path / "works"), 2000).orderBy("paper_id").collect()
    assert [(r["paper_id"], r["abstract"], r["authors"]) for r in rows] == [("W1", "a b a", ["A B"]), ("W4", None, None)]
    assert [(r["paper_id"], r["place"]) for r in readers.newest(readers.works(spark, str(tmp_path / "works")), 2).orderBy("place").collect()] == [("W4", 1), ("W1", 2)]
