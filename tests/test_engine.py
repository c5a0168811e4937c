import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions.query import Query
from lodestone.operators import bm25, corpus, locate, retrieve, scoring
from lodestone.plans import service
from lodestone.plans.engine import SearchEngine
from lodestone.sources.textfiles import TextFiles

SMOKE = ["Python is a language", "Vector DB", "Machine learning"]


def smoke(spark):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(SMOKE)], "doc_id long, text string")


def test_golden_scores(spark):
    """Worked out by hand from the formulas, with stems."""
    docs, q = smoke(spark), Query("language", stems=True)
    score = {r.doc_id: r.bm25 for r in bm25.score_all(docs, q).collect()}
    assert score[1] == pytest.approx(0.417001, abs=1e-6) and score[2] == 0
    assert {r.doc_id: r.bm25 for r in bm25.score_all(docs, Query("vector")).collect()}[2] == pytest.approx(0.575578, abs=1e-6)
    df = docs.where("doc_id = 1").select(F.col("text").alias("content"), F.lit(0.5).alias("embedding_similarity"), F.lit(score[1]).alias("bm25_score"))
    r = scoring.scored(df, q).first()
    b = r.similarity_breakdown
    assert b.bm25 == pytest.approx(0.041700, abs=1e-6)
    assert b.morphological_match == pytest.approx(0.852632, abs=1e-6)
    assert b.topic_relevance == pytest.approx(0.071579, abs=1e-6)
    assert (b.semantic_distance, b.exact_matches) == (1.0, 1.0)
    assert r.similarity == pytest.approx(0.367822 + 0.12 * 0.5, abs=1e-6)


def test_index_and_scan_agree(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat on the mat cat"), (2, "a dog"), (3, ""), (4, None), (5, "cat dog cat")], "doc_id long, text string")
    q = Query("cat cat dog the is")
    scanned = {r.doc_id: r.bm25 for r in bm25.score_all(docs, q).collect()}
    index = bm25.Index.fit(docs).save(str(tmp_path / "i"))
    found = {r.doc_id: r.bm25 for r in index.score(q).collect()}
    for i, s in scanned.items():
        assert s == pytest.approx(found.get(i, 0.0))
    assert set(bm25.score_all(docs, Query("")).toPandas().bm25) == {0.0}
    twice = {r.doc_id: r.bm25 for r in bm25.score_all(docs, Query("cat cat")).collect()}
    once = {r.doc_id: r.bm25 for r in bm25.score_all(docs, Query("cat")).collect()}
    assert all(twice[i] == pytest.approx(2 * once[i]) for i in once)


def test_components_stay_in_range(spark):
    rows = ["class Foo { public void bar() }", "", "for each function callback", "x" * 400, None]
    df = spark.createDataFrame([(t, 0.3, 1.0) for t in rows], "content string, embedding_similarity double, bm25_score double")
    for query in ("create class for function", "zzz", " "):
        for stems in (False, True):
            for r in scoring.scored(df, Query(query, stems)).collect():
                b = r.similarity_breakdown
                assert all(0 <= b[k] <= 1 for k in ("topic_relevance", "semantic_distance", "morphological_match", "exact_matches")) and r.similarity <= 1


def test_best_by_key_keeps_the_first_of_equals(spark):
    rows = [("a", 0.5, 1, 1), ("a", 0.7, 2, 1), ("a", 0.7, 3, 1), ("b", 0.1, 1, 2)]
    df = spark.createDataFrame(rows, "key string, embedding_similarity double, strategy int, rank int")
    got = {r.key: (r.embedding_similarity, r.strategy, tuple(r.position)) for r in retrieve.best_by_key(df).collect()}
    assert got == {"a": (0.7, 2, (1, 1)), "b": (0.1, 1, (1, 2))}


def test_places(spark):
    docs = spark.createDataFrame([(1, "say function function\nthe Function x\nno")], "doc_id long, text string")
    got = [(r.line, r.column, r.match_type) for r in locate.match_rows(docs, Query("functions")).orderBy("nth").collect()]
    assert got == [(1, 5, "morphological"), (1, 14, "morphological"), (1, 5, "morphological"), (1, 14, "morphological"), (2, 5, "morphological")]
    got = [(r.line, r.column, r.match_type) for r in locate.match_rows(docs, Query("The function")).orderBy("nth").collect()]
    assert (2, 1, "phrase") in got and len(got) <= 10


def test_states(spark):
    db = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, size long")
    fs = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "path string, size long")
    assert {r.path: r.action for r in corpus.sync_plan(db, fs).collect()} == {"a": "delete", "b": "keep", "c": "update", "d": "insert"}
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(corpus.changed_paths(db, fs)) == ["c", "d"] and paths(corpus.new_paths(db, fs)) == ["d"] and paths(corpus.removed_paths(db, fs)) == ["a"]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / ".deep" / "_sub").mkdir(parents=True)
    (root / "empty.txt").write_bytes(b"")
    (root / ".hidden.md").write_bytes(b"hidden class")
    (root / ".deep" / "_sub" / "_under.py").write_bytes(b"def function(): return 1")
    (root / "UPPER.TXT").write_bytes(b"upper\r\ncase\rfile")
    (root / "bad.json").write_bytes(b"caf\xe9 \xff ok")
    (root / "skip.bin").write_bytes(b"no")
    return root


def test_source_reads_every_file(spark, folder):
    got = {r.filename: r for r in corpus.files(spark, str(folder)).collect()}
    assert set(got) == {"empty.txt", ".hidden.md", "_under.py", "UPPER.TXT", "bad.json"}
    assert got["bad.json"].content == "caf  ok" and got["UPPER.TXT"].content == "upper\ncase\nfile" and got["empty.txt"].size == 0
    assert TextFiles.name() == "textfiles"


def test_engine_life(spark, folder, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "db"), index_path=str(folder))
    assert engine.search("anything", 3, 0.0).count() == 0
    assert engine.index_directory(str(folder)) == 5 and engine.index_directory(str(folder)) == 5
    assert engine.collection.read().count() == 5
    path = engine.add_document("A language for machines", "My title!")
    assert os.path.exists(path) and os.path.basename(path).startswith("My_title_")
    found = engine.search("language", 2, 0.1)
    assert found.first().file_path == path
    report = engine.text_report(found)
    assert report.startswith("Found ") and "MERGED RESULT" in report and "line 3, col 3" in report
    assert json.loads(engine.json_report(found))["results"][0]["metadata"]["title"] == "My title!"
    assert engine.search("  ", 2, 0.1).count() == 0
    os.remove(folder / "empty.txt")
    (folder / "bad.json").write_text("longer than before")
    (folder / "new.md").write_text("fresh")
    plan = {os.path.basename(r.path): r.action for r in engine.sync_with_filesystem().collect()}
    assert plan["empty.txt"] == "delete" and plan["bad.json"] == "update" and plan["new.md"] == "insert" and plan[".hidden.md"] == "keep"
    assert {r.action for r in engine.sync_with_filesystem().collect()} == {"keep"}
    again = SearchEngine(spark, str(tmp_path / "db"), index_path="/elsewhere")
    assert again.index_path == str(folder) and again.warnings


def test_requests(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "db"), index_path=str(tmp_path / "docs"))
    ask = lambda method, url, body=b"": service.respond(engine, method, url, body, {})[0]
    assert ask("GET", "/health") == 200 and ask("GET", "/search?q=") == 400 and ask("GET", "/x") == 404 and ask("POST", "/x") == 404
    assert ask("POST", "/add", b"{}") == 400 and ask("POST", "/index", b'{"directory": "/nowhere"}') == 400 and ask("POST", "/index") == 400
    assert ask("POST", "/add", json.dumps({"content": "Python is a language"}).encode()) == 200
    assert ask("GET", "/search?q=language&threshold=0.1&format=text") == 200
    status, kind, body = service.respond(engine, "GET", "/search?q=language&threshold=0.1", b"", {})
    assert kind == "application/json" and len(json.loads(body)["results"]) == 1
    with pytest.raises(ValueError):
        ask("GET", "/search?q=a&max_results=x")
    assert math.isclose(service.parser().parse_args(["search", "q"]).similarity_threshold, 0.7)


def test_stream_of_files(spark, folder, tmp_path):
    from lodestone.streaming import ingest

    engine = SearchEngine(spark, str(tmp_path / "db"), index_path=str(folder))
    ingest.start(engine, str(folder), str(tmp_path / "cp")).awaitTermination(90)
    names = {r.filename for r in engine.collection.read().collect()}
    assert "UPPER.TXT" in names and "skip.bin" not in names


def test_command_line_shows_parts(spark, tmp_path, capsys):
    base = ["--db-path", str(tmp_path / "db"), "--index-path", str(tmp_path / "docs"), "--similarity-threshold", "0.1"]
    service.main([*base, "add", "Python is a language"], spark)
    out = service.main([*base, "search", "language"], spark)
    lines = out.splitlines()
    assert lines[0] == "Found 1 documents" and lines[1].startswith("1. ")
    assert lines[2].startswith("   BM25: ") and "Topic Relevance: " in lines[2] and "Morphological: " in lines[2]
    assert lines[3].startswith("   Raw BM25 Score: ") and out in capsys.readouterr().out
    assert service.main([*base, "search", "  "], spark) == "Found 0 documents\n"


def test_a_failing_strategy_leaves_the_others(spark, tmp_path, monkeypatch):
    engine = SearchEngine(spark, str(tmp_path / "db"), index_path=str(tmp_path / "docs"))
    engine.add_document("Python is a language")
    whole, calls = engine._vector, []

    def failing(words):
        calls.append(words)
        if len(calls) == 1:
            raise RuntimeError("no model")
        return whole(words)

    monkeypatch.setattr(engine, "_vector", failing)
    assert engine.search("language", 2, 0.1).count() == 1
    assert engine.warnings == ["strategy 1 failed: no model"]
