import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.query import Query
from lodestone.operators import bm25, corpus
from lodestone.operators.segments import FAN, Segments
from lodestone.plans.engine import SearchEngine, hashed_embedding

Q = Query("w1 w2 w2 w7 rare")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def scores(index):
    return {r.doc_id: round(r.bm25, 9) for r in index.score(Q).collect()}


def files(path):
    return {str(p.relative_to(path)) for p in pathlib.Path(path).rglob("*.parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    return bm25.StoredIndex(spark, str(tmp_path / "i"))


def test_changes_give_what_a_refit_gives(spark, stored):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(12)}" for _ in range(rng.choice([0, 1, 8, 30])))
    held = {}
    for step in range(7):
        new = {f"d{rng.randrange(20)}": text() for _ in range(rng.choice([1, 6]))}
        gone = {f"d{rng.randrange(20)}" for _ in range(3)} - set(new) if step else set()
        stored.change(docs(spark, list(new.items())), docs(spark, [(g, "") for g in gone]) if gone else None)
        held = {k: t for k, t in held.items() if k not in gone} | new
        if step % 2 == 0:
            fitted = bm25.Index.fit(docs(spark, list(held.items())))
            index = stored.index()
            assert scores(index) == scores(fitted)
            assert {tuple(r) for r in index.terms.collect()} == {tuple(r) for r in fitted.terms.collect()}
            assert index.corpus.first() == fitted.corpus.first()
    stored.change(gone=docs(spark, [(k, "") for k in held]))
    assert scores(stored.index()) == {} and stored.segments.totals() == (0, 0)
    stored.change(docs(spark, [("x", "w1 rare")]), whole=True)
    assert set(scores(stored.index())) == {"x"}


def test_a_change_writes_what_belongs_to_it(spark, stored, tmp_path):
    stored.change(docs(spark, [(f"d{i}", f"w{i % 7} " * 20) for i in range(300)]))
    before = files(tmp_path / "i")
    stored.change(docs(spark, [("new", "rare words")]))
    added = files(tmp_path / "i") - before
    assert before <= files(tmp_path / "i")
    rows = {t: sum(spark.read.parquet(str(tmp_path / "i" / p)).count() for p in added if p.startswith(t)) for t in ("postings", "documents", "dead", "state")}
    assert rows == {"postings": 2, "documents": 1, "dead": 0, "state": 2}
    stored.change(gone=docs(spark, [("d5", "")]))
    dead = [p for p in files(tmp_path / "i") if p.startswith("dead")]
    assert sum(spark.read.parquet(str(tmp_path / "i" / p)).count() for p in dead) == 1


def test_a_search_reads_only_its_terms(spark, stored):
    stored.change(docs(spark, [("a", "w1 w2"), ("b", "w3")]))
    plan = stored.index().score(Q)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [In(term, [rare,w1,w2,w7])") == plan.count("FileScan") == 2


def test_what_breaks_off_is_not_seen(spark, stored, tmp_path, monkeypatch):
    stored.change(docs(spark, [("a", "w1 w2"), ("b", "w2 w7")]))
    before = scores(stored.index())
    with monkeypatch.context() as m:
        m.setattr(Segments, "_write_state", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            stored.change(docs(spark, [("a", "rare")]), docs(spark, [("b", "")]))
    assert scores(stored.index()) == before
    # Another writer begins with the same state and comes first.
    other, versions = bm25.StoredIndex(spark, str(tmp_path / "i")), stored.segments.versions()
    other.change(docs(spark, [("c", "w1 rare")]))
    after = scores(other.index())
    with monkeypatch.context() as m:
        m.setattr(Segments, "versions", lambda self: versions)
        with pytest.raises(Exception, match="already exists"):
            stored.change(docs(spark, [("d", "w7")]))
    assert scores(stored.index()) == after and set(after) == {"a", "b", "c"}


def test_merging(spark, tmp_path):
    s = Segments(spark, str(tmp_path / "s"), "k", {"rows": "k long, n long"}, "n")
    rows = lambda *ks: {"rows": spark.createDataFrame([(k, k) for k in ks], "k long, n long")}
    for k in range(FAN + 1):
        s.change(rows(k), note=str(k))
    assert len(s.state()) == 2 and s.note == str(FAN) and s.totals() == (FAN + 1, sum(range(FAN + 1)))
    assert sorted(r.k for r in s.read().collect()) == list(range(FAN + 1))
    # Most rows of the large segment go: it is rewritten without them.
    s.change(rows(99), spark.createDataFrame([(k,) for k in range(6)], "k long"))
    assert all(x["n_dead"] == 0 and not x["dead_by"] for x in s.state()) and sorted(r.k for r in s.read().collect()) == [6, 7, 8, 99]
    assert s.totals() == (4, 120) and len(s.versions()) <= 3
    named = {x["segment"] for v in s.versions() for x in s.state(v)}
    assert {p.name.removeprefix("segment=") for p in (tmp_path / "s" / "rows").iterdir() if p.is_dir()} <= named


def test_rows_of_one_path(spark, tmp_path):
    c = corpus.Collection(spark, str(tmp_path / "c"))
    assert c.read().collect() == [] and c.versions() == []
    row = lambda p, n: spark.createDataFrame([(p, p, p, n, None, None, "", "", None)], corpus.SCHEMA)
    for p, n in (("a", 1), ("a", 2), ("b", 3)):
        c.append(row(p, n))
    assert sorted((r.file_path, r.size) for r in c.read().collect()) == [("a", 1), ("a", 2), ("b", 3)]
    c.delete(spark.createDataFrame([("a",), ("a",), ("z",)], "path string"))
    assert [r.file_path for r in c.read().collect()] == ["b"]
    c.change(row("b", 9), spark.createDataFrame([("b",)], "file_path string"))
    assert [(r.file_path, r.size) for r in c.read().collect()] == [("b", 9)]


def test_a_stored_index_is_used_and_followed(spark, tmp_path, monkeypatch):
    """A new engine's first search fits nothing, adding a file touches one segment, and a sync without changes opens no file."""
    root = tmp_path / "docs"
    root.mkdir()
    for i in range(12):
        (root / f"f{i}.txt").write_text(f"language number{i} of twelve")
    args = (spark, str(tmp_path / "db"))
    SearchEngine(*args, index_path=str(root)).index_directory(str(root))
    engine = SearchEngine(*args)
    fitted, read = [], []
    whole, contents = bm25.weighed_postings, corpus.contents
    monkeypatch.setattr(bm25, "weighed_postings", lambda d: fitted.append(d.count()) or whole(d))
    monkeypatch.setattr(corpus, "contents", lambda d: read.append(d.count()) or contents(d))
    assert engine.search("number3", 1, 0.05).first().file_path.endswith("f3.txt") and fitted == []
    assert {r.action for r in engine.sync_with_filesystem().collect()} == {"keep"} and fitted == read == []
    (root / "f3.txt").write_text("number33")
    (root / "f4.txt").unlink()
    (root / "f99.txt").write_text("number99")
    engine.sync_with_filesystem()
    assert fitted == read == [2] and engine.stored.segments.totals()[0] == 12
    assert engine.search("number99", 1, 0.05).first().file_path.endswith("f99.txt")
    # A change that broke off between collection and index is made up for.
    engine.collection.delete(spark.createDataFrame([(str(root / "f99.txt"),)], "path string"))
    engine.search("number1", 1, 0.05).collect()
    assert fitted == [2, 11] and engine.stored.segments.totals()[0] == 11


def test_embedding_counts_signed_hashes(spark):
    words = ["one", "two", "one", "déjà", "", "three"] * 40
    df = spark.createDataFrame([(" ".join(words),), ("",), (None,)], "t string")
    plain = df.select(F.explode(F.split("t", " ")).alias("w")).where("w <> ''").select(F.expr("int(pmod(xxhash64(w), 16))").alias("at"), F.expr("IF(hash(w) % 2 = 0, 1.0, -1.0)").alias("x"))
    want = [0.0] * 16
    for r in plain.collect():
        want[r.at] += float(r.x)
    got = [r.v for r in df.select(hashed_embedding(F.col("t"), 16).alias("v")).collect()]
    assert got == [want, [0.0] * 16, None]
