import corpus_pipeline
from tests.conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "token: abcdefghijklmnopq is said here", "en", "s", 37)], docs.schema)
    docs, sizes = docs.unionByName(odd), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = step(spark, docs, DATA)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == odd.columns and len(rows) <= before
        sizes.append(len(rows))
    assert not any("abcdefghijklmnopq" in (r["text"] or "") for r in rows)
    assert len({r["text"] for r in rows if r["text"]}) == sum(bool(r["text"]) for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


CLASHING = "doc_id long, text string, kept int, log_weight string, gumbel_key int, quill_row int, row int, Row_ int, score int, draw int, toxicity int, spans int, `a.b` int"


def test_columns_that_clash_pass_through(spark):
    texts = [(1, "plain words are here"), (2, None), (None, "x"), (4, "long " * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "2", *range(3, 12)) for i, t in texts], CLASHING)
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, DATA)
        assert got.columns == docs.columns, name
        assert {tuple(r)[2:] for r in got.collect()} <= {(1, "2", 3, 4, 5, 6, 7, 8, 9, 10, 11)}, name


def test_an_empty_table_passes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs, DATA).count() == 0, name


def test_repeated_ids_lose_no_other_text(spark):
    a, other = "one two three four five six seven", "nothing like it is written in any other row"
    docs = spark.createDataFrame([(1, a), (2, a), (2, other), (2, other), (3, ""), (3, ""), (None, a)], "doc_id long, text string")
    got = corpus_pipeline.keep_one_copy(spark, docs, DATA).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (2, other), (3, ""), (3, "")]
