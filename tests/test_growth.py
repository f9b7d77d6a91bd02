"""What a query gathers, ships or holds as tables grow, seen in its plan on small tables."""
import random
import re
from difflib import SequenceMatcher
from pathlib import Path

from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import fixed_values as V
from quillspark.functions import text
from quillspark.operators import resolve as D
from quillspark.operators import columns, ranking, sentences, sketches
from quillspark.plans import analysis_queries as A
from quillspark.plans import literature
from quillspark.plans import text_queries as T
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_titles_are_not_gathered_in_the_driver(spark):
    """pieces of titles are many, whatever the size of the file that the titles come from."""
    found = plan(D.fuzzy_pairs(A.records(spark, DATA)))
    assert "SortMergeJoin" in found and "Broadcast" not in found


def test_the_fold_gathers_no_records_in_the_driver(spark):
    """records meet what they were taken into, and keys their first offer, by shuffles."""
    records = spark.createDataFrame([(1, "d", None, "t", "a", 2020), (2, "d", None, "u", "a", 2020)], "seq long, doi string, arxiv string, title string, author string, year int")
    assert "Broadcast" not in plan(D.standing(records, records.select("seq", F.lit(1).cast("long").alias("canonical"))))
    rows = spark.createDataFrame([("k", 1, 1, None), ("k", 2, 2, None)], "key string, canonical long, low long, high long")
    assert "Broadcast" not in plan(D.soonest(rows))
    near = spark.createDataFrame([("t", "t")], "title string, other string")
    known = D.standing(records, records.select("seq", F.col("seq").alias("canonical")))
    assert "Broadcast" not in plan(D.offers(rows.select(F.col("canonical").alias("seq"), "key"), known, near))


def test_a_run_looks_up_duplicates_by_a_shuffle(spark):
    """the records that the fold takes away grow with the corpus."""
    found = plan(literature.corpus(A.with_ids(spark, DATA), "the and thing", 20))
    assert "LeftAnti" in found and not [line for line in found.splitlines() if "BroadcastHashJoin" in line and "LeftAnti" in line]


def test_shuffles_of_an_input_are_dealt_to_small_tasks(spark):
    """What one task holds doesn't grow with the input; a session's own choice stays."""
    known = {c: spark.conf.get(c, None) for c in (session.SHARE, session.PARTS)}
    try:
        for c in known:
            spark.conf.unset(c)
        session.table(spark, DATA, "orders")
        assert spark.conf.get(session.SHARE) == f"{session.SHARE_MB}m" and int(spark.conf.get(session.PARTS)) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(session.SHARE, "8m")
        session.table(spark, DATA, "orders")
        assert spark.conf.get(session.SHARE) == "8m"
    finally:
        for c, value in known.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)


def test_overlaps_of_many_users_are_exact(spark):
    """more users than a sketch holds."""
    rows = spark.range(20_000).select(F.col("id").alias("paper_id"), (2020 + F.col("id") % 2).cast("int").alias("year"), F.lit("a").alias("name"))
    rows = rows.unionByName(spark.range(5_000).select(F.col("id").alias("paper_id"), F.lit(2021).alias("year"), F.lit("b").alias("name")))
    found = sketches.exact_overlaps(sketches.paper_bitmaps(rows)).collect()
    assert [tuple(r) for r in found] == [(2020, 2021, 10_000, 12_500, 2_500)]


def test_an_index_of_words_is_made_without_a_shuffle(spark):
    """a word's places in a text are found where the text is."""
    assert "Exchange" not in plan(T.QUERIES["inverted_index_text"](spark, DATA))
    words = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "id int, w array<string>")
    found = {r[0]: r[1] and [(e["word"], e["at"]) for e in r[1]] for r in words.select("id", text.grouped(F.col("w"))).collect()}
    assert found == {1: [("a", [1]), ("b", [0, 2])], 2: None, 3: None, 4: [("x", [0])]}


def test_sentences_are_split_into_words_once(spark):
    """what all categories ask of a sentence isn't evaluated once for each."""
    rows = spark.createDataFrame([(1, 1, "Results", "we show the data")], "paper_id int, seq int, section string, text string")
    found = plan(sentences.scored(rows.repartition(2)))
    assert found.count("split(") == 1, found


def test_families_are_looked_up_once(spark):
    """F16: every pattern of the families stands once in the plan, not once for each fact."""
    names = spark.createDataFrame([("a",), ("b",)], "name string").repartition(2)
    pattern = "|".join(V.METHOD_FAMILIES[0][-1])
    assert plan(D.consolidated_methods(names)).count(pattern) == 1


def test_few_papers_are_chosen_before_lines_are_joined(spark):
    """the papers of links are a filter of the lines themselves, in front of every shuffle."""
    found = plan(A.QUERIES["evidence_quotes"](spark, DATA))
    assert [line for line in found.splitlines() if "Filter" in line and re.search(r"l_orderkey#\d+L? (IN|INSET) ", line)], found


def test_words_are_counted_where_the_text_is(spark):
    """counts need no shuffle, unless rows share an id."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, None), (3, "bb")], "id int, text string")
    tf, _ = ranking.tallied(docs, [], "id", "text")
    assert "Exchange" not in plan(tf)
    assert sorted(map(tuple, tf.collect())) == [(1, "aa", 2), (1, "bb", 1), (3, "bb", 1)]
    tf, df = ranking.tallied(docs.unionByName(spark.createDataFrame([(1, "bb cc")], docs.schema)), ["cc"], "id", "text")
    assert sorted(map(tuple, tf.collect())) == [(1, "aa", 2), (1, "bb", 2), (3, "bb", 1)]
    assert sorted(map(tuple, df.collect())) == [("aa", 1, 4), ("bb", 2, 4)]


def test_many_choices_need_few_passes(spark, monkeypatch):
    """a pass gives a shortlist, choices are made among it; the length of a vector is evaluated once, not for each component."""
    passes, over = [], DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda df, *rest: passes.append(1) or over(df, *rest))
    rows = spark.range(300).select("id", (F.col("id") / 300).alias("score"), F.array(*(F.rand(i) - 0.5 for i in range(6))).alias("v"))
    assert ranking.diversified(rows, 20).count() == 20 and len(passes) <= 6, len(passes)
    seen = spark.range(1).select(columns.unit(F.array(F.lit(3.0), F.col("id").cast("double") + 4.0)).alias("v"), columns.unit(F.array(F.col("id").cast("double"))).alias("none"))
    assert seen.first() == ([0.6, 0.8], None)
    assert re.search(r"transform\(array\(CASE WHEN", plan(seen)), plan(seen)


def test_titles_that_share_a_piece_by_chance_are_no_pairs(spark):
    """of a crowd with one common beginning only titles of like letters are written as pairs."""
    rng = random.Random(4)
    rows = [(n, "commonbeginning" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=33)), 2020) for n in range(200)]
    rows.append((200, rows[7][1][:-1] + "?", 2021))
    found = {tuple(r) for r in D.sharing(spark.createDataFrame(rows, "seq long, clean_title string, year int")).collect()}
    assert (7, 200) in found and len(found) <= 20  # of 20,100


def test_edited_titles_of_any_length_are_found(spark):
    """letters dropped, added and moved, at the ratio's border too."""
    rng = random.Random(5)
    titles = []
    for length in (1, 2, 6, 7, 12, 13, 25, 26, 40, 49, 50, 75):
        for _ in range(3):
            base = rng.choices("abcdeß漢", k=length)
            titles.append("".join(base))
            for edits in (1, 2, 3, 4, 5, 6, 7):
                t = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(t) + 1)
                    t[at:at + rng.choice((0, 1, 1))] = rng.choices("abcdeß漢", k=rng.choice((0, 1)))
                titles.append("".join(t))
    titles = sorted(set(titles) - {""})
    frame = spark.createDataFrame(list(enumerate(titles)), "seq long, clean_title string").withColumn("year", F.lit(2020))
    found = {(r["a"], r["b"]) for r in D.candidates(frame).collect()}
    wanted = {(a, b) for b, y in enumerate(titles) for a, x in enumerate(titles[:b]) if max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio()) >= D.RATIO}
    assert len(wanted) > 100 and wanted <= found


def test_a_round_of_the_fold_leaves_no_files(spark):
    """what a round writes between its steps goes with the round."""
    at = Path(session.shared_dir(spark).removeprefix("file:")) / "quillspark"
    known = set(at.glob("**/*")) if at.exists() else set()
    rows = [(1, "a", "x", 2020, "d1"), (2, "b", "y", 2020, "d1"), (3, "b", "z", 2021, "d2"), (4, "c", "z", 2021, "d2")]
    made = spark.createDataFrame(rows, "seq long, title string, author string, publication_year int, doi string").withColumn("arxiv_id", F.lit(None).cast("string"))
    assert sorted(r["duplicate"] for r in D.fold(made).collect()) == [2, 4]
    assert not [f for f in set(at.glob("**/*")) - known if re.match("standing|rows|best|offers|round", f.name)]


def test_frequent_words_get_their_weights_where_the_text_is(spark):
    """Only rare words of a text are shuffled, each once; which are rare changes nothing."""
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (2, "aa dd"), (3, "aa bb"), (4, None), (5, "")], "id int, text string")
    tf, df = ranking.tallied(docs, [], "id", "text")
    made = {n: sorted(map(tuple, ranking.raw_weights(tf, df, "id", n).collect())) for n in (0, 1, 2, 9)}
    assert len(made[9]) == 7 and all(made[n] == made[9] for n in made)
    held = plan(ranking.raw_weights(tf, df, "id"))
    assert "salt" not in held and held.count("hashpartitioning(word") == 2, held


def test_choices_leave_no_files(spark):
    """what a choice writes between its passes goes with it."""
    at = Path(session.shared_dir(spark).removeprefix("file:")) / "quillspark"
    known = set(at.glob("**/*")) if at.exists() else set()
    rows = spark.range(30).select("id", F.rand(1).alias("score"), F.array(F.rand(2), F.rand(3)).alias("v"))
    assert ranking.diversified(rows, 5).count() == 5
    assert not [f for f in set(at.glob("**/*")) - known if f.suffix == ".parquet"]


def test_contexts_are_folded_without_a_group_for_each_paper(spark):
    """papers follow each other in a task, those without an id too."""
    rows = [(p, s, "Abstract", f"we show the data of {s} with the method") for p in (None, 1, 2**60 + 1) for s in range(1, 13)]
    found = sentences.context(spark.createDataFrame(rows, "paper_id long, seq int, section string, text string"), cues=T.CUES)
    assert "MapInArrow" in plan(found) and "FlatMapGroups" not in plan(found)
    made = [tuple(r) for r in found.collect()]
    per = {p: sorted(r[1:] for r in made if r[0] == p) for p in (None, 1, 2**60 + 1)}
    assert len(made) == 3 * len(per[1]) > 0 and per[None] == per[1] == per[2**60 + 1]
