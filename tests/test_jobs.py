import os
import pathlib
import re
import subprocess
import sys
from collections import Counter

import pytest

from pyspark.sql import Window, functions as F

from jobs import index_stream, saved_searches
from jobs.common import defaults
from lodestone.functions.query import Query
from lodestone.operators import bm25

ROOT = pathlib.Path(__file__).parents[1]
DOC = "doc_id long, text string, lang string"


def write(spark, rows, folder, at):
    """rows as one more file in folder, with its time of change."""
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(str(folder))
    for name in set(os.listdir(folder)) - before:
        os.utime(folder / name, (1_600_000_000 + at, 1_600_000_000 + at))


def expected(texts):
    """texts by id: the postings."""
    out = set()
    for i, t in texts.items():
        terms = Counter(Query(t or "").bm25_terms)
        out |= {(i, term, n, sum(terms.values())) for term, n in terms.items()}
    return out


def found(spark, target):
    rows = [tuple(r) for r in index_stream.postings(spark, target).drop("bucket").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def files(target):
    return {(p, p.stat().st_mtime_ns) for p in pathlib.Path(target).rglob("*.parquet")}


@pytest.fixture
def paths(tmp_path):
    return tmp_path / "documents", str(tmp_path / "index"), str(tmp_path / "checkpoint")


def test_growing_input(spark, paths):
    source, target, checkpoint = paths
    write(spark, [(1, "the cat sat on the cat", "en"), (2, "a dog", "en"), (3, None, "de"), (None, "nobody", "en"), (4, "", "en"), (5, "old words here", "en")], source, 1)
    assert index_stream.run(spark, str(source), target, checkpoint) == 1
    first = {1: "the cat sat on the cat", 2: "a dog", 3: None, 4: "", 5: "old words here"}
    assert found(spark, target) == expected(first)
    before = files(target)
    assert index_stream.run(spark, str(source), target, checkpoint) == 0 and files(target) == before

    write(spark, [(2, "a dog and a cat", "en"), (6, "new", "fr"), (6, "new", "fr"), (5, "", "en")], source, 2)
    assert index_stream.run(spark, str(source), target, checkpoint) == 1
    now = first | {2: "a dog and a cat", 6: "new", 5: ""}
    assert found(spark, target) == expected(now)
    assert before <= files(target), "what was written before is left alone"
    assert {r.doc_id: (r.dl, r.batch) for r in index_stream.live(spark, target).collect()}[5] == (0, 1)

    q = Query("cat cat dog new")
    fitted = bm25.Index.fit(spark.createDataFrame(list(now.items()), "doc_id long, text string"))
    scores = lambda index: {r.doc_id: pytest.approx(r.bm25) for r in index.score(q).collect()}
    assert scores(index_stream.index(spark, target)) == scores(fitted)


def test_all_at_once_gives_the_same(spark, paths, tmp_path):
    """Files that come one by one and files that come together make one index; small batches too."""
    source, target, checkpoint = paths
    for at in range(3):
        write(spark, [(i, f"word{at} of document {i}", "en") for i in range(at, 5)], source, at)
        index_stream.run(spark, str(source), target, checkpoint)
    whole = found(spark, target)
    assert whole == expected({i: f"word{min(i, 2)} of document {i}" for i in range(5)})
    for per_batch in (1, 64):
        other = str(tmp_path / f"o{per_batch}")
        index_stream.run(spark, str(source), f"{other}/index", f"{other}/cp", {"files_per_batch": per_batch, "buckets": 3})
        assert found(spark, f"{other}/index") == whole


def test_a_batch_that_broke_off_is_run_again(spark, paths, monkeypatch):
    source, target, checkpoint = paths
    write(spark, [(1, "first words", "en")], source, 1)
    index_stream.run(spark, str(source), target, checkpoint)
    write(spark, [(1, "other words", "en"), (2, "more", "en")], source, 2)
    whole = bm25.doc_stats

    def failing(docs):
        raise RuntimeError("lost")

    monkeypatch.setattr(bm25, "doc_stats", failing)
    with pytest.raises(Exception, match="lost"):
        index_stream.run(spark, str(source), target, checkpoint)
    assert found(spark, target) == expected({1: "first words"})
    monkeypatch.setattr(bm25, "doc_stats", whole)
    assert index_stream.run(spark, str(source), target, checkpoint) == 1
    assert found(spark, target) == expected({1: "other words", 2: "more"})


def test_empty_table(spark, paths):
    source, target, checkpoint = paths
    write(spark, [], source, 1)
    index_stream.run(spark, str(source), target, checkpoint)
    assert found(spark, target) == set()


def tables(spark, tmp_path, docs, queries):
    spark.createDataFrame(docs, DOC).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(queries, "item_id long, text string").write.parquet(str(tmp_path / "q"))
    return str(tmp_path / "d"), str(tmp_path / "q"), str(tmp_path / "r")


def test_saved_searches(spark, tmp_path):
    docs = [(i, f"alpha{i % 3}\nbeta gamma{i} and beta\nbeta", "en") for i in range(30)] + [(40, None, "en"), (41, "", "de")]
    queries = [(1, "alpha0 gamma3"), (2, "BETA"), (3, "nothing of it"), (4, None), (5, "gamma7 gamma7 alpha1"), (6, "")]
    d, q, r = tables(spark, tmp_path, docs, queries)
    config = {"top": 4, "least": -100.0, "parts": 3}
    n = saved_searches.run(spark, d, q, r, config)
    rows = sorted(tuple(x) for x in saved_searches.read(spark, r).drop("part").collect())
    frame = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    for key, words in queries:
        scores = {x.doc_id: round(x.bm25, 6) for x in bm25.Index.fit(frame).score(Query(words or "")).collect()}
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert [(x[1], x[2], x[3]) for x in rows if x[0] == key] == [(i, *x) for i, x in enumerate(best, 1)]
    # The line with most of the query's terms, the first of equals.
    assert {(x[2], x[6], x[7]) for x in rows if x[0] == 2} == {(i, 2, 1) for i in range(4)}
    assert [x[5:] for x in rows if x[:2] == (1, 1)] == [(2, 1, 1)]
    assert saved_searches.run(spark, d, q, r, config) == n == len(rows)
    assert sorted(tuple(x) for x in saved_searches.read(spark, r).drop("part").collect()) == rows
    assert {p.name for p in pathlib.Path(r).iterdir() if p.is_dir()} <= {f"part={i}" for i in range(3)}


def test_saved_searches_over_nothing(spark, tmp_path):
    d, q, r = tables(spark, tmp_path, [], [(1, "a b")])
    assert saved_searches.run(spark, d, q, r) == 0 and saved_searches.read(spark, r).count() == 0


def test_command_line(spark, paths, tmp_path):
    source, target, checkpoint = paths
    write(spark, [(1, "some words", "en")], source, 1)
    config = tmp_path / "c.json"
    config.write_text('{"buckets": 2}')
    command = [sys.executable, "-m", "jobs.index_stream", "--documents", str(source), "--index", target, "--checkpoint", checkpoint, "--config", str(config), "--master", "local[1]"]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: 1 rows read, 1 documents and 2 postings written" in done.stderr
    assert found(spark, target) == expected({1: "some words"})


def test_jobs_stand_alone():
    for p in [*(ROOT / "jobs").glob("*.py"), ROOT / "tests/test_jobs.py"]:
        assert not re.search(r"^\s*(from|import) .*(llm|corpus_pipeline)", p.read_text(), re.M), p
    assert defaults("index_stream")["buckets"] > 0 and defaults("saved_searches")["top"] > 0


def test_searches_move_no_pairs(spark, tmp_path):
    """Of searches whose terms all documents have, only the best leave a task; several passes give the same, and so does an index without documents."""
    docs = spark.createDataFrame([(i, f"of in {'rare ' * (i % 3)} word{i % 7}", "en") for i in range(600)], DOC).repartition(3).select("doc_id", "text")
    queries = spark.createDataFrame([(i, f"of in word{i % 7} rare") for i in range(40)] + [(None, "rare")], "query_id long, text string")
    fitted = bm25.Index.fit(docs)
    assert fitted._search_some([r for r in bm25.tokenized(queries.select(F.col("query_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("query_id"), F.explode("tokens").alias("term"), F.lit(1).alias("times")).collect()], {"query_id": queries.schema["query_id"].dataType, "doc_id": docs.schema["doc_id"].dataType}, 4, None, 6, 1.5, 0.75).count() <= 41 * 4 * 3
    scored = fitted.score_many(queries).withColumn("bm25", F.round("bm25", 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id")
    want = sorted(map(repr, (tuple(r) for r in scored.withColumn("rank", F.row_number().over(best)).where("rank <= 4").select("query_id", "rank", "doc_id", "bm25", "n_terms").collect())))
    found = lambda index: sorted(repr(tuple(r)) for r in index.search_many(queries, 4).collect())
    assert found(fitted) == want == found(bm25.Index(fitted.postings, fitted.terms, fitted.corpus))
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(bm25, "AT_ONCE", 7)
        assert found(fitted) == want
