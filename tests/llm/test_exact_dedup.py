import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from lodestone.llm import exact_dedup as E
from lodestone.session import table

from .brute import LOWER, UPPER


def expected(rows):
    groups = defaultdict(list)
    norm = lambda t: (t or "").translate(str.maketrans(UPPER, LOWER))
    for i, t in rows:
        groups[norm(t)].append(i)
    return {(i, max(groups[norm(t)]), len(groups[norm(t)]), i == max(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


def found(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def hash_of(kind):
    of = xxhash.xxh3_64_intdigest
    return {"usual": of, "few": lambda c: of(c) % 3, "one": lambda c: 0}[kind]


@pytest.mark.parametrize("kind", ["usual", "few", "one"])
@pytest.mark.parametrize("size", [3, 4096])
def test_against_grouping_by_text(spark, kind, size):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abAB") for _ in range(rng.choice([0, 1, 2, 3, 6, 7, 40]))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "É" * 50), (503, "é" * 50), (504, "aB" * 9000), (505, "Ab" * 9000), (506, "Ab" * 8999 + "ac")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(E.exact_duplicates(df, size, hash_of(kind))) == expected(rows)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(E.query(spark, "/root/testdata/sf0.001")) == expected(rows)


def test_repeated_rows_null_ids_clashing_columns(spark):
    rows = [(1, "a", 5), (1, "a", 6), (None, "A", 7), (None, "b", 8), (2, "c", 9), (2, "C", 10), (3, None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name long")
    got = E.exact_duplicates(df).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 4
    kept = E.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower(), r.name) for r in kept.collect() if r.doc_id != 2) == [(0, "b", 8), (1, "a", 5), (3, "", 11)]
    two = [r.text for r in kept.collect() if r.doc_id == 2]
    hashed = {r.text: r.h for r in df.where("doc_id = 2").selectExpr("text", "xxhash64(text) AS h").collect()}
    assert two == [max(hashed, key=hashed.get)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert E.exact_duplicates(empty).collect() == [] and E.drop_exact_duplicates(empty).collect() == []


def test_a_large_group_is_dealt_out(spark):
    """More rows than one part may have, and a very long text."""
    rows = [(i, "Same" if i % 3 else "same") for i in range(900)] + [(1000, "x" * 300_000), (1001, "X" * 300_000), (1002, "x" * 299_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(E.exact_duplicates(df)) == expected(rows)
    assert sorted(r.doc_id for r in E.drop_exact_duplicates(df).collect()) == [899, 1001, 1002]
