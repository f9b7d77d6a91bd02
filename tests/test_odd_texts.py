"""Queries over documents whose texts and sources are empty, missing or of rare letters, against DuckDB."""
import duckdb
import pytest

from quillspark.plans import catalogue
from tests.test_queries import rows

TEXTS = ["", " ", "  \n", "...", None, "same title", "Same, title!", "The\x0bcat", "A FOR all for b", "straße ß ßa", "ﬁne ŉ ᾳ ǆ", "İstanbul ΟΔΟΣ", "😀 via x"]
SOURCES = ["src1", "SRC-1", "", None, "Smith, J", "Jane Doe", ","]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    made = [(n, t, s) for n, (t, s) in enumerate((t, s) for s in SOURCES for t in TEXTS)] + [(None, "no id", "src1"), (None, "no id", "src2"), (900, "no id", "src2"), (-7, "below", "src1")]
    spark.createDataFrame(made, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["merge_records", "title_key_dedup", "title_functions"])
def test_odd_documents_equal_sql(spark, odd, name):
    """an empty text is no missing one, nor are sources; letters change case one by one."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    got = catalogue.QUERIES[name](spark, odd)
    result = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, result.fetchall())
