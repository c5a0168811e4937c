import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from lodestone.llm import filter_audit as A
from lodestone.session import table

D = "/root/testdata/sf0.001"


def fails(text, copy):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    found = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return found + "E" * copy


def expected(docs, labels):
    """docs (doc_id, text, source), labels (doc_id, quality, toxic)"""
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    judged = []
    for i, t, part in docs:
        copy = any((u or "") == (t or "") and i is not None and j is not None and j < i for j, u, _ in docs)
        judged.append((part or "", fails(t or "", copy), i in good, i in toxic))
    out, whole = {}, Counter()
    for part in {p for p, *_ in judged}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in judged if x[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failing = [x for x in judged if x[0] == part and letter in x[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(x[1] == letter for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone))
                whole[part, letter] += len(gone)
    return {k: (*v, whole[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "a", 0), (2, LONG, "a", 0), (2, LONG, "b", 0), (3, None, None, 0), (4, "", "", 0), (None, LONG, "a", 0), (5, "x " * 70, "b", 0),
    (6, "X\x0by z#", "b", 0), (7, LONG.upper(), "b", 0), (8, LONG + " %", "c", 0), (9, "É" * 3000, "c", 0), (9, "É" * 3000, "c", 0), (10, "long" * 100_000, "c", 0),
    (11, LONG + " last", "d", 0), (1, LONG, "a", 0),
]
LABELS = [(1, 1, 0, 9), (2, 1, 1, 9), (2, 1, 1, 9), (5, 0, 1, 9), (7, None, 1, 9), (99, 1, 1, 9), (None, 1, 1, 9), (8, 1, None, 9)]


@pytest.mark.parametrize("parts", [2, A.PARTS])
def test_against_each_order_in_turn(spark, monkeypatch, parts):
    monkeypatch.setattr(A, "PARTS", parts)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, mask int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, part int")
    got = A.audit(docs, labels)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert found(got) == expected([r[:3] for r in ROWS], [r[:3] for r in LABELS])


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).collect() == []
    some = spark.createDataFrame([(1, LONG, "a"), (2, LONG, "a")], "doc_id long, text string, source string")
    assert found(A.audit(some, labels)) == expected([(1, LONG, "a"), (2, LONG, "a")], [])


def test_copies_are_dealt_out(spark):
    """One text in two thousand rows, of which one is the first."""
    rows = [(i, "same" if i % 4 else f"text {i}", "hot") for i in range(3000)]
    masks = A.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7))
    assert {r.doc_id for r in masks.where(f"mask & {A.COPY} != 0").collect()} == {i for i in range(3000) if i % 4} - {1}


def test_table_of_first_failures():
    table = A.first_failures("ABC")
    for mask in range(8):
        for j, order in enumerate(A.orders("ABC")):
            failing = [s for s, x in enumerate(order) if mask >> "ABC".index(x) & 1]
            assert table[mask, j] == min(failing, default=3)
    assert A.first_failures().shape == (32, 120) and np.all(A.first_failures()[0] == 5)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = A.query(spark, D)
    want = con.execute(f"select {', '.join(got.columns)} from ({A.SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 600 * table(spark, D, "documents").select("source").distinct().count()
