"""What must not grow faster than the input: rows that move, tokens that are carried along, rows of one task."""

import pathlib

from pyspark.sql import functions as F

from jobs import index_stream
from lodestone.functions import text
from lodestone.operators import bm25


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_counted(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["x"]), (4, ["é", "é", "z"])], "i int, w array<string>")
    got = {r.i: r.c and [tuple(x) for x in r.c] for r in rows.select("i", text.counted(F.col("w")).alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: None, 3: [("x", 1)], 4: [("z", 1), ("é", 2)]}


def test_postings_move_no_rows_and_find_tokens_once(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc_id long, text string")
    found = bm25.weighed_postings(docs)
    assert {tuple(r) for r in found.collect()} == {(1, "a", 2, 3), (1, "b", 1, 3)}
    assert "Aggregate" not in plan(found) and plan(found).count("split(") == 1


def test_a_bucket_goes_to_more_tasks_as_it_grows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common {i} w{i}x{i * 7919 % 1009} v{i}", "en") for i in range(4000)], "doc_id long, text string, lang string")
    docs.repartition(8).write.parquet(str(tmp_path / "d"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "8k")
    try:
        index_stream.run(spark, str(tmp_path / "d"), str(tmp_path / "i"), str(tmp_path / "c"), {"buckets": 2, "files_per_bucket": 1})
    finally:
        spark.conf.set(size, before)
    files = list(pathlib.Path(tmp_path / "i/postings/batch=0").glob("bucket=*/*.parquet"))
    assert len(files) > 2 * 2, len(files)
    assert index_stream.postings(spark, str(tmp_path / "i")).where("term = 'common'").count() == 4000


def test_forms_of_one_word(spark):
    from lodestone.functions import forms

    words = ["", "a", "class", "classes", "running", "prefix_abc", "ünïcode", "aaaaaa", "properties", "abcd"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", forms.forms_of_one(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in rows} == {w: forms.all_forms(w) for w in words}


def test_words_are_held_against_a_query_line_by_line(spark):
    from lodestone.functions.query import Query
    from lodestone.operators import locate

    rows = [(1, "Function dfunction\nfunctional, function;éfunction function_x"), (2, None), (3, ""), (4, "nothing here"), (5, "fun ion\n\nunion UNION\nFUNCTIONS")]
    docs = spark.createDataFrame([*rows, (6, "function\n" * 30)], "doc_id long, text string")
    found = locate.match_rows(docs, Query("function"))
    # No list of a whole document's words is made: lines that can have no match, or come after the last one wanted, are not split.
    assert "array_distinct" not in plan(found) and "contains(" in plan(found).lower()
    got = [tuple(r) for r in found.orderBy("doc_id", "nth").collect()]
    assert [(d, line, col) for d, _, line, col, kind in got if kind == "phrase"] == [(1, 1, 1), (1, 2, 1), (5, 4, 1), *((6, i, 1) for i in range(1, 11))]
    assert [(d, line, col) for d, _, line, col, kind in got if kind != "phrase"] == [(5, 3, 1), (5, 3, 7)] * 2  # each of two words, each at both places
    places = locate.match_rows(docs, Query("other functional")).where("doc_id = 1").select("line", "column").collect()
    assert [tuple(r) for r in places] == [(1, 1), (2, 1), (2, 13), (2, 32)]


def test_words_outside_the_vocabulary_meet_no_pattern(spark):
    from lodestone.operators import scoring

    docs = spark.createDataFrame([(1, "xclass a, class B classes Élan class\tb functions_ 9type def"), (2, None), (3, "")], "doc_id long, text string")
    found = docs.select("doc_id", F.array_sort(scoring.concepts(F.col("text"))).alias("c"))
    assert "rlike" not in plan(found).lower()
    assert {r.doc_id: r.c for r in found.collect()} == {1: ["b", "class", "classes"], 2: None, 3: []}
