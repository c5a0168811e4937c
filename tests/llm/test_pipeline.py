from collections import defaultdict

import corpus_pipeline as P
from lodestone.session import Scratch, table

from .brute import LOWER, UPPER, near_duplicates


def test_stages_in_order(spark):
    """Each stage's rows, from what the one before kept."""
    d = "/root/testdata/sf0.001"
    scratch, docs = Scratch(spark, "t"), table(spark, d, "documents")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = scratch.save(stage(spark, docs, d), name)
        assert out.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        before, docs = {r.doc_id: r.text for r in docs.collect()}, out
        assert set(kept[name]) <= set(before)
    norm = lambda t: t.translate(str.maketrans(UPPER, LOWER))
    last = defaultdict(int)
    for i, t in kept["quality"].items():
        last[norm(t)] = max(last[norm(t)], i)
    assert set(kept["exact"]) == set(last.values())
    assert set(kept["near"]) == {c for _, c in near_duplicates(list(kept["exact"].items())).values()}
    good = {r.doc_id for r in table(spark, d, "labels").where("quality = 1").collect()}
    assert good & set(kept["language"]) <= set(kept["quality"])
    packed = P.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(kept["near"])


NAMES = "_k_row int, _k_id int, _k_text int, _K_told int, _k_lang int, g int, _g int, _part int, size int, kept int, text_key int, lang_pred int, component_id int, n int, piece int"


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts go; repeats, ties and null ids have one defined outcome; names of columns don't matter."""
    words = "the river runs past an old mill and over stones where children play while birds sing in tall green trees all day long".split()
    text = lambda i: " ".join(words[(i * 7 + j * (1 + i % 5)) % len(words)] for j in range(80))
    rows = [(i, text(i), "en") for i in range(60)]
    rows += [(70, None, "en"), (71, "", "en"), (72, None, None), (73, text(3).upper(), "en"), (5, text(5), "en"), (5, text(5), "en"), (None, text(8), "en"), (74, text(9) + " end", None)]
    names = [c.split()[0] for c in NAMES.split(", ")]
    docs = spark.createDataFrame([(*r, "s", None, *([k] * len(names))) for k, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scratch = Scratch(spark, "odd")
    ids = {}
    for name, stage in P.STAGES[:-1]:
        out = scratch.save(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        docs, ids[name] = out, [r.doc_id for r in out.select("doc_id").collect()]
    assert {70, 71, 72}.isdisjoint(ids["language"]) and set(range(60)) <= set(ids["language"])
    assert ids["quality"].count(5) == ids["language"].count(5) == 3
    same = defaultdict(list)
    for i, t, _ in rows:
        if i in ids["quality"]:
            same[t.lower()].append(i)
    assert len(ids["exact"]) == len(same)
    assert sorted(ids["near"], key=str) == sorted(set(ids["near"]), key=str) and set(ids["near"]) <= set(ids["exact"])
    packed = P.packing(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted(ids["near"], key=str)
    empty = docs.where("false")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == []
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_names():
    assert [n for n, _ in P.STAGES] == ["language", "quality", "exact", "near", "packing"]
