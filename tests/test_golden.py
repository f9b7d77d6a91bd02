"""Values known by hand: concentration, trajectories, identifiers, lifecycle, identities of the vector metrics."""
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules, text
from quillspark.functions.numbers import composite_confidence
from quillspark.operators import density, evidence, gaps, graph, ranking, resolve, serving, trends, vectors
from quillspark.sources import writers


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def uses(spark, counts):
    return spark.createDataFrame([(i, f"d{k}") for k, n in enumerate(counts) for i in range(n)], "paper_id long, name string")


@pytest.mark.parametrize("counts, hhi, label", [([7, 2, 1, 1, 1, 1], 0.3373, "Highly Concentrated Benchmarks"), ([2] + [1] * 14, 0.0703, "Well-Diversified Benchmarks")])
def test_hhi(spark, counts, hhi, label):
    got = trends.concentration(uses(spark, counts)).first()
    assert (got["hhi"], got["label"]) == (hhi, label)


def test_hhi_of_nothing(spark):
    got = trends.concentration(uses(spark, [])).first()
    assert (got["uses"], got["hhi"], got["label"]) == (0, 0.0, "Well-Diversified")


def test_shares(spark):
    papers = spark.range(40).select(F.col("id").alias("paper_id"))
    rows = [(i, "a") for i in range(9)] + [(i, n) for i in (9, 10) for n in "bc"]
    got = trends.concentration_shares(spark.createDataFrame(rows, "paper_id long, name string"), papers).first()
    assert (got["single_share"], got["multi_share"]) == (22.5, 5.0)


def yearly(spark, counts, role="component", size=10):
    papers, mentions, k = [], [], 0
    for year, n in enumerate(counts, 2020):
        for i in range(size):
            papers.append((k, year))
            if i < n:
                mentions.append((k, year, 0, "x", role))
            k += 1
    return spark.createDataFrame(mentions, "paper_id long, year int, seq int, name string, role string"), spark.createDataFrame(papers, "paper_id long, year int")


@pytest.mark.parametrize("counts, role, growth, name", [
    ((1, 1, 2, 2), "component", 100.0, "INCREASING"), ((0, 0, 2, 2), "proposed", 100.0, "EMERGING"), ((0, 0, 2, 2), "baseline", 100.0, "INCREASING"), ((2, 2, 2), "component", 0.0, "STABLE"), ((4, 1, 1, 0), "component", -80.0, "DECLINING")])
def test_trajectory(spark, counts, role, growth, name):
    got = trends.trajectory(*yearly(spark, counts, role)).first()
    assert got["growth"] == pytest.approx(growth)
    assert got["trajectory"] == name


@pytest.mark.parametrize("n, role, name", [(1, "baseline", "BASELINE_COMPARATOR"), (3, "component", "DOMINANT"), (2, "component", "STABLE"), (1, "component", "SPECIALIZED")])
def test_snapshot(spark, n, role, name):
    assert trends.trajectory(*yearly(spark, (n,), role)).first()["trajectory"] == name


@pytest.mark.parametrize("papers, recent, status", [(5, 3, "UNADDRESSED"), (3, 1, "PARTIALLY_ADDRESSED"), (2, 0, "CONVERGED"), (1, 0, "UNADDRESSED")])
def test_lifecycle(spark, papers, recent, status):
    assert one(spark, gaps.lifecycle(F.lit("theme_x"), F.lit(papers), F.lit(recent))["status"]) == status


def test_identifiers(spark):
    assert [one(spark, text.doi(F.lit(x))) for x in ("https://doi.org/10.1/AB", "doi:10.1/ab")] == ["10.1/ab"] * 2
    assert [one(spark, text.arxiv_id(F.lit(x))) for x in ("http://arxiv.org/abs/2305.12345v2", "2305.1234", "foo")] == ["2305.12345v2", "2305.1234", None]
    assert [one(spark, text.author_token(F.lit(x))) for x in ("Kargupta, A.", "Aniket Kargupta")] == ["kargupta"] * 2


def test_text_functions(spark):
    for t in ("chain-of-thought (cot)", "éa b3c ñ", "ß straße", ""):
        assert one(spark, text.py_title(F.lit(t))) == t.title()
    assert one(spark, text.clean_line_noise(F.lit("a hyphen-\n ated  word\t x"))) == "a hyphenated word x"
    assert one(spark, text.clean_line_noise(F.lit("12 "))) == ""
    got = one(spark, text.sentences(F.lit("As shown in FIG. 2 it works well. See e.g.the second one! Short. Is this the third sentence?")))
    assert got == ["As shown in Fig. 2 it works well.", "See e.g. the second one!", "Is this the third sentence?"]
    assert [one(spark, text.heading(F.lit(x))) for x in ("2. Methods", "MIMIC Data", "One Two Three Four Five Six Seven")] == ["Methods", "Data", None]


def test_strategies(spark):
    got = one(spark, text.query_strategies(F.lit("Vision Transformers  for medical image segmentation")))
    assert got == ["Vision Transformers medical image segmentation", "Transformers medical", "Vision Transformers medical", "medical image segmentation", "Vision segmentation"]


def test_rules(spark):
    names = rules.normalised(F.lit("a clinical LLM system"), rules.V.METHOD_NAMES)
    assert one(spark, names) == "Large Language Model"
    assert one(spark, rules.normalised(F.lit("our method"), rules.V.METHOD_NAMES)) == ""
    assert one(spark, rules.normalised(F.lit("'some new thing'"), rules.V.METHOD_NAMES)) == "Some New Thing"
    assert one(spark, rules.category_of(F.lit("4 Experimental Setup"))) == "datasets"
    assert one(spark, rules.theme(F.lit("GPU memory and latency"))["theme_id"]) == "theme_compute_scaling"
    assert one(spark, rules.theme(F.lit("it takes time"))["category"]) == "computational_cost"


def test_numbers(spark):
    assert one(spark, composite_confidence(F.lit(0.92), F.lit(0.95), F.lit(1.0), F.lit(0.90))) == pytest.approx(0.9445)
    assert [one(spark, evidence.first_number(F.lit(x))) for x in ("BLEU-4 4.98", "-5", "+2.4%", "none")] == [4.0, 5.0, 2.4, None]


def test_donut(spark):
    sizes = spark.createDataFrame(list(enumerate([6, 3, 3, 3, 3, 2])), "cluster_id int, n long")
    assert [r["percent"] for r in gaps.donut(sizes).orderBy("cluster_id").collect()] == [30, 15, 15, 15, 15, 10]


@pytest.mark.parametrize("n, rows", [(29, 22), (80, 38), (250, 64), (251, 68)])
def test_grid_sizes(spark, n, rows):
    assert vectors.param_grid(spark, n).count() == rows


def test_vector_identities(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = rng.integers(0, 3, 40)
    m = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, cluster_id int, v array<double>")
    intra = {r["cluster_id"]: r["intra"] for r in vectors.intra_similarity(m).collect()}
    got = {r["id"]: r["silhouette"] for r in vectors.silhouette(m).collect()}
    d = 1 - x @ x.T
    for c in range(3):
        own = x[label == c]
        pairs = (own @ own.T)[np.triu_indices(len(own), 1)]
        assert intra[c] == pytest.approx(pairs.mean())
    for i in range(40):
        a = d[i][(label == label[i]) & (np.arange(40) != i)].mean()
        b = min(d[i][label == c].mean() for c in range(3) if c != label[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_density_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (15, 2)) for c in (0, 3, 6)] + [rng.uniform(-3, 9, (4, 2))])
    for method in ("eom", "leaf"):
        labels = density.density_labels(x, 5, 2, method)
        groups = [set(labels[i * 15 : i * 15 + 15]) - {-1} for i in range(3)]
        assert all(groups) and not (groups[0] & groups[1] or groups[1] & groups[2])


def test_mmr_prefers_new_directions(spark):
    pool = spark.createDataFrame([(0, 1.0, [1.0, 0.0]), (1, 0.6, [1.0, 0.01]), (2, 0.55, [0.0, 1.0])], "id long, score double, v array<double>")
    assert [r["id"] for r in ranking.diversified(pool, 2).orderBy("place").collect()] == [0, 2]


def test_mmr_reads_the_whole_pool(spark):
    rows = [(i, 1.0 - i * 1e-5, [1.0, 0.0]) for i in range(2100)] + [(2100, 0.9, [0.0, 1.0]), (2101, -10.0, [1.0, 0.0])]
    pool = spark.createDataFrame(rows, "id long, score double, v array<double>")
    assert [r["id"] for r in ranking.diversified(pool, 3).orderBy("place").collect()] == [0, 2100, 1]


def test_density_search_reads_all_embeddings(spark, monkeypatch):
    from quillspark.plans import analysis_queries
    from tests.conftest import DATA

    read, search = [], vectors.search
    monkeypatch.setattr(vectors, "search", lambda v, n: read.append((v, n)) or search(v, n))
    analysis_queries.density(spark, DATA)
    every = spark.read.parquet(f"{DATA}/embeddings.parquet")
    (v, n), = read
    assert n == v.count() == every.count()
    assert v.selectExpr("min(size(v))", "max(size(v))").first() == every.selectExpr("min(size(embedding))", "max(size(embedding))").first()


def test_fuzzy_titles_against_brute_force(spark):
    titles = ["deep learning for images", "deep learning for image", "deep learning of images", "something else entirely", "deep lerning for images", "deep learning for images"]
    rows = [(i, f"p{i}", t, "", "A B", 2020 + i % 2, None, None, "s") for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, RECORD)
    got = {(r["canonical"], r["duplicate"]) for r in resolve.fuzzy_pairs(df).collect()}
    clean = {}
    for i, t in enumerate(titles):
        clean.setdefault(("".join(c for c in t if c.isalnum()), 2020 + i % 2), i)
    want = {(i, j) for (a, _), i in clean.items() for (b, _), j in clean.items() if i < j and SequenceMatcher(None, b, a).ratio() >= 0.92}
    assert got == want and {(0, 1), (0, 2), (0, 4), (0, 5), (1, 5), (2, 5)} <= got


def test_fuzzy_titles_lose_no_pair(spark):
    """Random edits anywhere, insertions at the front among them, against all pairs."""
    import random

    random.seed(3)
    letters, titles = "abcdefgh", []
    for _ in range(25):
        base = "".join(random.choice(letters) for _ in range(random.choice([4, 7, 20, 57])))
        titles.append(base)
        for _ in range(5):
            t = base
            for _ in range(random.randint(0, 5)):
                at = random.randint(0, len(t))
                t = random.choice([t[:at] + random.choice(letters) + t[at:], t[:at] + t[at + 1 :], "the" + t])
            titles.append(t)
    rows = [(i, f"p{i}", t, "", "A B", 2020 + i % 3, None, None, "s") for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, RECORD)
    first = {}
    for i, t in enumerate(titles):
        if t:
            first.setdefault((t, 2020 + i % 3), i)
    want = {(i, j) for (a, x), i in first.items() for (b, y), j in first.items() if i < j and abs(x - y) <= 1 and SequenceMatcher(None, b, a).ratio() >= 0.92}
    assert {(r["canonical"], r["duplicate"]) for r in resolve.fuzzy_pairs(df).collect()} == want and len(want) > 40


RECORD = "seq long, paper_id string, title string, abstract string, author string, publication_year int, doi string, arxiv_id string, source string"


def folded_by_hand(rows):
    """The rules in a plain loop over (seq, title, author, year, doi, arxiv)."""
    clean = lambda t: "".join(c for c in (t or "") if c.isalnum()).lower()
    known, made = [], set()
    for seq, title, author, year, doi, arxiv in rows:
        r = {"seq": seq, "t": clean(title), "a": clean(author.split()[-1] if author.split() else ""), "y": year, "d": doi, "x": arxiv}
        for c in known:
            near = r["y"] and c["y"] and abs(r["y"] - c["y"]) <= 1 and r["t"] and c["t"] and SequenceMatcher(None, r["t"], c["t"]).ratio() >= 0.92
            how = "doi" if r["d"] and r["d"] == c["d"] else "arxiv" if r["x"] and r["x"] == c["x"] else "title" if (r["t"], r["a"], r["y"]) == (c["t"], c["a"], c["y"]) else "fuzzy" if near else None
            if how:
                made.add((seq, c["seq"], how))
                for k in "tydx":
                    c[k] = c[k] or r[k]
                break
        else:
            known.append(r)
    return made


def test_fold_equals_the_plain_loop(spark):
    """Among them: an identifier that a merge brings makes a later record match; a missing year is filled."""
    rows = [
        (0, "deep learning for images", "A B", 2020, "d1", None), (1, "something else", "C D", 2021, "d1", "x7"), (2, "third thing here", "E F", 2019, None, "x7"),
        (3, "a paper without a year", "G H", None, None, "x9"), (4, "another", "G H", 2015, None, "x9"), (5, "a paper without a yeer", "Q", 2016, None, None),
        (6, "deep learning for image", "Z", 2021, None, None), (7, "unrelated words", "I J", 2000, None, None), (8, "", "K L", None, None, None), (9, "", "K L", None, None, None), (10, "unrelated words", "I J", 2000, None, None),
    ]
    df = spark.createDataFrame([(s, f"p{s}", t, "", a, y, d, x, "s") for s, t, a, y, d, x in rows], RECORD)
    assert {tuple(r) for r in resolve.fold(df).select("duplicate", "canonical", "method").collect()} == folded_by_hand(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_of_random_records_with_crossing_keys(spark, seed):
    """Few identifiers and titles, much missing: merges bring keys that change what later records match, those of equal keys too."""
    import random

    r = random.Random(seed)
    titles = ["", "neural nets for text", "neural nets for texts", "neural net for texts", "graph mining at scale", "graph mining at scales", "x", "y"]
    rows = []
    for s in range(2000 if seed == 1 else 150):
        wide = s // 20 if seed == 1 else 0
        rows.append((
            s, r.choice(titles) + (f" of the long run number {r.randint(0, wide)}" if wide and r.random() < 0.7 else ""), r.choice(["A B", "C D", ""]), r.choice([None, None, 2019, 2020, 2021, 2022, 2030]),
            r.choice([None] * 4 + [f"10.1/{r.randint(0, 4 + wide)}"]), r.choice([None] * 4 + [f"ax{r.randint(0, 4 + wide)}"])))
    df = spark.createDataFrame([(s, f"p{s}", t, "", a, y, d, x, "s") for s, t, a, y, d, x in rows], RECORD)
    assert {tuple(r) for r in resolve.fold(df).select("duplicate", "canonical", "method").collect()} == folded_by_hand(rows)


def test_fold_of_one_giant_group(spark):
    """20,000 records of one boilerplate title, of few and of many years: each meets one canonical record or two."""
    rows = [(s, f"p{s}", "proceedings of the workshop" + ("s" if s % 3 else ""), "", "A B", 2020 + s % 2, None, None, "s") for s in range(20_000)]
    got = resolve.fold(spark.createDataFrame(rows, RECORD)).collect()
    assert len(got) == 19_999 and {r["canonical"] for r in got} == {0}


def test_fold_of_no_records(spark):
    assert resolve.fold(spark.createDataFrame([], RECORD)).count() == 0


def test_fold_of_the_table(spark):
    from quillspark.plans import analysis_queries
    from tests.conftest import DATA

    df = analysis_queries.with_ids(spark, DATA)
    rows = [(r["seq"], r["title"], r["author"], r["publication_year"], r["doi"] and r["doi"].removeprefix("doi:"), r["arxiv_id"]) for r in df.orderBy("seq").collect()]
    assert {tuple(r) for r in resolve.fold(df).select("duplicate", "canonical", "method").collect()} == folded_by_hand(rows)


def test_context_equals_the_plain_fold(spark):
    from quillspark.operators import sentences
    from quillspark.sources import tables
    from tests.conftest import DATA

    found = tables.scholarly(spark, DATA)
    by = {}
    for r in sentences.scored(found).where("score > 1").collect():
        by.setdefault(r["paper_id"], {}).setdefault(r["category"], []).append((-r["score"], r["seq"]))
    want = set()
    for paper, kinds in by.items():
        seen = set()
        for name in sentences.V.CATEGORIES:
            taken = 0
            for minus, seq in sorted(kinds.get(name, [])):
                if taken < 8 and (seq not in seen or taken < 3):
                    taken += 1
                    seen.add(seq)
                    want.add((paper, name, taken, seq, -minus))
    got = {tuple(r) for r in sentences.context(found).select("paper_id", "category", "rank", "seq", "score").collect()}
    assert got == want and len(want) > 50


def test_mmr_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 5))
    score = rng.integers(0, 10, 60) / 10
    x, rel, chosen = v / np.linalg.norm(v, axis=1, keepdims=True), (score - score.min()) / (score.max() - score.min()), []
    while len(chosen) < 12:
        value = [(0.6 * rel[i] - 0.4 * max((float(x[i] @ x[j]) for j in chosen), default=0.0), score[i], -i) for i in range(60) if i not in chosen]
        chosen.append(-max(value)[2])
    pool = spark.createDataFrame([(i, float(score[i]), v[i].tolist()) for i in range(60)], "id long, score double, v array<double>")
    assert [r["id"] for r in ranking.diversified(pool, 12).orderBy("place").collect()] == chosen


def test_duplicate_labels_equal_brute_force(spark):
    names = ["Deep Learning", "deep learning ", "Deep Learnings", "Graph Nets", "Graph Net", "Other"]
    got = {(r["a"], r["b"], round(r["ratio"], 9)) for r in serving.duplicate_labels(spark.createDataFrame(list(enumerate(names)), "cluster_id long, label string")).collect()}
    each = [n.lower().strip() for n in names]
    assert got == {(i, j, round(SequenceMatcher(None, a, b).ratio(), 9)) for i, a in enumerate(each) for j, b in enumerate(each) if i < j and SequenceMatcher(None, a, b).ratio() >= 0.8}


def test_cluster_selection(spark):
    """Three dense groups are found; two looser ones that the best setting leaves as noise are found in the second pass or stay noise."""
    rng = np.random.default_rng(4)
    centres = np.eye(8)[:5]
    rows = [c + rng.normal(0, 0.02, 8) for c in centres[:3] for _ in range(12)] + [c + rng.normal(0, 0.1, 8) for c in centres[3:] for _ in range(6)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, v array<double>")
    got = {r["id"]: r["cluster_id"] for r in vectors.selected(df).collect()}
    groups = [{got[i] for i in range(12 * g, 12 * g + 12)} - {-1} for g in range(3)]
    assert sorted(got) == list(range(48)) and all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert vectors.selected(df.limit(0)).count() == 0


def test_metrics_of_a_matrix_equal_those_of_the_table(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = rng.integers(-1, 4, 50)
    m = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, cluster_id int, v array<double>")
    want, got = vectors.metrics(m).first(), vectors.numpy_metrics(x, label)
    for k in ("clusters", "noise", "largest", "smallest", "silhouette", "intra", "inter", "entropy", "score"):
        assert got[k] == pytest.approx(want[k]), k


def test_blocks_of_pages(spark):
    from quillspark.operators import sentences

    html = '<style>p{}</style><h2 class="x">2. Methods &amp; Co</h2><!-- <p>no</p> --><p id=1>One <b>bold</b><br>line</p><ul><li>an &lt;item&gt;</li></ul><script>var t="</p>"</script><table><tr><td>cell</td></tr></table><pre>code</pre>'
    got = [r["raw_text"] for r in sentences.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("block_idx").collect()]
    assert got == ["2. Methods & Co", "One bold\nline", "an <item>", "cell", "code"]


def test_literature_indexes_are_routed(spark):
    from quillspark.operators import extraction

    scan = spark.createDataFrame([(1, 1, "PubMed Central", False, "S1", 1, "Abstract", "q"), (1, 2, "NSL-KDD", False, "S2", 1, "Abstract", "q"), (1, 3, "dataset", False, "S2", 1, "A", "q")], "paper_id long, idx int, raw string, proposal boolean, sentence_id string, page int, section string, quote string")
    got = sorted((r["target"], r["idx"], r["name"], r["modality"]) for r in extraction.datasets(scan).collect())
    assert got == [("dataset", 1, "NSL-KDD", "tabular"), ("literature_source", 1, "Pubmed Central", None)]


def test_each_batch_counts_a_repeated_batch_once(spark, tmp_path):
    from quillspark.streaming import events

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([("a", 1.0 + i), ("b" if i else "c", 2.0)], "k string, v double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(source)
    events.each_batch(stream, path, str(tmp_path / "c"), ["k"], ["v"]).start().awaitTermination()
    want = [("a", 6.0), ("b", 4.0), ("c", 2.0)]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/v=2").select("k", "v").collect()) == want
    # the last batch once more, from the version before it: as after a failure between its write and its commit
    import shutil

    shutil.rmtree(tmp_path / "c" / "commits")
    (tmp_path / "c" / "commits").mkdir()
    for n in (0, 1):
        (tmp_path / "c" / "commits" / str(n)).write_text('v1\n{"nextBatchWatermarkMs":0}')
    events.each_batch(stream, path, str(tmp_path / "c"), ["k"], ["v"]).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/v=2").select("k", "v").collect()) == want


def test_graph(spark):
    m = spark.createDataFrame([(1, "m1", "proposed"), (1, "m2", "baseline")], "paper_id long, id string, role string")
    d = spark.createDataFrame([(1, "d1")], "paper_id long, id string")
    kinds = sorted((r["source_id"], r["relation_type"], r["target_id"]) for r in graph.edges(m, d).collect())
    assert kinds == [("d1", "USED_IN", "paper_1"), ("m1", "COMPARED_WITH", "m2"), ("m1", "EVALUATED_ON", "d1"), ("m1", "PROPOSED_BY", "paper_1"), ("m2", "USED_IN", "paper_1")]
    assert graph.ego_network(graph.edges(m, d), "nobody").count() == 0


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    writers.write_run(df, path, "r1")
    writers.write_run(df, path, "r2")
    writers.write_run(df.union(df), path, "r1")
    assert {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"r1": 2, "r2": 1}
    assert "| 1 | a |" in writers.markdown_report("T", {"S": df})
    fixed = one(spark, writers.repaired_json(F.lit('```json\n{"k": 1,}\n```'), "k INT"))
    assert fixed["k"] == 1


def test_ego_edges_of_nodes_known_and_unknown(spark):
    m = spark.createDataFrame([(1, "m1", "proposed"), (1, "m2", "baseline")], "paper_id long, id string, role string")
    d = spark.createDataFrame([(1, "d1")], "paper_id long, id string")
    nodes = spark.createDataFrame([("m1",), ("m2",), ("alone",)], "node_id string")
    made = graph.edges(m, d)
    assert sorted((r["source_id"], r["target_id"]) for r in graph.ego_edges(made, nodes, "m2").collect()) == [("m1", "m2"), ("m2", "paper_1")]
    assert graph.ego_edges(made, nodes, "alone").count() == 0
    with pytest.raises(LookupError):
        graph.ego_edges(made, nodes, "nobody")


def test_links_with_quotes(spark):
    rows = gaps.themed(spark.createDataFrame([(1, 2, "later words on gpu", 2020), (1, 1, "gpu memory " + "x" * 300, 2020), (2, 1, "gpu", 2020), (3, 1, "gpu", 2020), (4, 1, "gpu", 2022)], "paper_id long, seq int, text string, year int"))
    methods = spark.createDataFrame([(2, 2, "B", "says b"), (2, 1, "A", None), (4, 1, " ", " ")], "paper_id long, seq int, name string, quote string")
    got = {r["target"]: (r["source"], r["relation"], r["method"], r["target_quote"], len(r["source_quote"])) for r in gaps.quoted_links(rows, methods).collect()}
    plain = "Proposes specialized framework to evaluate and mitigate domain bottlenecks."
    assert got == {2: (1, "EXTENDS", "A", "says b", 250), 3: (1, "CONFIRMS", None, plain, 250), 4: (1, "PARTIALLY_ADDRESSES", None, plain, 250)}
    named = methods.where("paper_id = 2 AND seq = 1")
    assert gaps.quoted_links(rows, named).where("target = 2").first()["target_quote"] == "Proposes A to evaluate and mitigate domain bottlenecks."
    assert gaps.quoted_links(rows.limit(0), methods).count() == 0


def test_themes_with_methods_and_benchmarks(spark):
    rows = gaps.themed(spark.createDataFrame([(1, 1, "gpu", 2020), (2, 1, "gpu", None), (3, 1, "fairness", 2021)], "paper_id long, seq int, text string, year int"))
    used = spark.createDataFrame([(p, f"M{i}") for p in (1, 2) for i in range(9)] + [(2, None)], "paper_id long, name string")
    got = {r["theme_id"]: r for r in gaps.detailed(rows, used, used).collect()}
    first = got["theme_compute_scaling"]
    assert first["methods"] == [f"M{i}" for i in range(6)] and first["benchmarks"] == [f"M{i}" for i in range(4)] and first["papers"] == 2
    assert got["theme_sample_efficiency"]["methods"] == []
    assert [r["theme_id"] for r in gaps.search(gaps.detailed(rows, used, used), text="m3").collect()] == ["theme_compute_scaling"]
