import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from lodestone.llm import toxicity as T
from lodestone.llm.folds import fold
from lodestone.session import table

from . import weights_by_folds


def test_terms_of_a_batch():
    texts = ["A dog, a DOG_cat", "", "école—Été 3x", "x" * 5000, " ..", "dog"]
    text, term, n, names = T.occurrences(pa.array(texts, pa.string()))
    got = [Counter() for _ in texts]
    for a, b, c in zip(text.tolist(), term.tolist(), n.tolist(), strict=True):
        got[a][names[b].as_py()] = c
    assert got == [Counter(T.terms(t)) for t in texts]
    assert T.terms("école—Été 3x") == ["école", "été", "3x"] and T.terms(None) == []


@pytest.mark.parametrize("long", (0.0, 1 / 16, 1.0))
def test_nearest_against_all_cosines(monkeypatch, long):
    """Whether lists are all long, some, or none."""
    monkeypatch.setattr(T, "LONG", long)
    rng = random.Random(4)
    for size, n in ((30, 400), (6, 90), (3, 5)):
        rows = []
        for _ in range(n):
            at = sorted(rng.sample(range(size), rng.randint(1, min(6, size))))
            w = np.array([rng.choice([1.0, 2.0, 3.5]) for _ in at])
            rows.append((at, w / np.sqrt((w * w).sum())))
        flat = lambda some: (np.repeat(np.arange(len(some)), [len(a) for a, _ in some]), np.array([t for a, _ in some for t in a], np.int64), np.concatenate([w for _, w in some]))
        index = T.Index(list(range(n)), [rng.randint(0, 1) for _ in range(n)], *flat(rows), size)
        full = np.zeros((n, size))
        for row, i in enumerate(index.ids):
            full[row, rows[i][0]] = rows[i][1]
        asked = rows[:60]
        text, example, cosine = index.nearest(*flat(asked), len(asked), 7)
        for q, (at, w) in enumerate(asked):
            v = np.zeros(size)
            v[at] = w
            score = np.round(full @ v, 12)
            want = [i for i in sorted(range(n), key=lambda i: (-score[i], i)) if score[i] > 0][:7]
            own = text == q
            assert np.allclose(cosine[own], score[want]) and example[own].tolist() == want
    none = T.Index([], [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 3)
    assert all(len(x) == 0 for x in none.nearest(np.array([0]), np.array([1]), np.array([1.0]), 1, 5))


def plain(docs, labels, k=T.NEIGHBOURS):
    """{doc_id: (score, [(example, cosine)])} from the formulas, with every cosine."""
    known = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 != 0:
            known[i] = max(known.get(i, 0), y)
    teach = {}
    for i, t in docs:
        if i in known and t is not None:
            a, y = teach.get(t, (i, 0))
            teach[t] = min(a, i), max(y, known[i])
    rows = [(i, Counter(T.terms(t)), y) for t, (i, y) in teach.items()]
    all_, ones = len(rows), sum(y for *_, y in rows)
    n, n1 = Counter(), Counter()
    for _, c, y in rows:
        n.update(c.keys())
        n1.update(c.keys() if y else ())

    def weight(t):
        table_ = [(n1[t], n[t], ones), (n[t] - n1[t], n[t], all_ - ones), (ones - n1[t], all_ - n[t], ones), (all_ - ones - n[t] + n1[t], all_ - n[t], all_ - ones)]
        g2 = 2 * sum(o * math.log(o * all_ / (a * b)) for o, a, b in table_ if o > 0 and a * b > 0)
        tells = min(1, max(0, g2 / T.FULL_G2)) if n1[t] / n[t] > T.LIFT * (ones - n1[t]) / max(all_ - n[t], 1) else 0
        return math.log(1 + all_ / n[t]) * max(tells, T.LEAST_WEIGHT)

    w = {t: weight(t) for t in n}

    def vector(c):
        v = {t: (1 + math.log(x)) * w[t] for t, x in c.items() if t in w}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    examples = [(i, vector(c), y) for i, c, y in rows]
    out = {}
    for i, t in docs:
        v = vector(Counter(T.terms(t)))
        near = sorted(((round(sum(x * e.get(s, 0) for s, x in v.items()), 9), j, y) for j, e, y in examples), key=lambda r: -r[0])
        near = [r for r in near if r[0] > 0]
        votes = [(c / (1.05 - min(c, 1)), y) for c, _, y in near[:k]]
        rate = ones / all_ if all_ else 0.0
        out[i] = (T.PRIOR * rate + sum(a * y for a, y in votes)) / (T.PRIOR + sum(a for a, _ in votes)), near
    return out


def test_query_against_plain_version(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    labels = [(r.doc_id, r.toxic) for r in table(spark, d, "labels").collect()]
    want = plain(docs, labels)
    got = {r.doc_id: r for r in T.query(spark, d).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        score, near = want[i]
        cosines = [c for c, *_ in near[: T.NEIGHBOURS]]
        assert np.allclose([e.cosine for e in r.evidence], cosines, atol=1e-8)
        of = {j: c for c, j, _ in near}
        assert all(abs(of[e.doc_id] - e.cosine) < 1e-8 for e in r.evidence)
        tied = len(near) > T.NEIGHBOURS and near[T.NEIGHBOURS - 1][0] == near[T.NEIGHBOURS][0]
        assert tied or abs(r.score - score) < 1e-6
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = T.query(spark, d).join(table(spark, d, "labels"), "doc_id").selectExpr("held_out", "score", "predicted", "toxic", "size(evidence) as found").where("held_out").toPandas()
    assert len(got) > 700
    assert (got.predicted == got.toxic).mean() > 0.98 and got[got.toxic == 1].predicted.mean() > 0.9
    assert got[got.toxic == 0].predicted.mean() < 0.01 and (got.found > 0).mean() > 0.99
    low, high = got[got.score < 0.1], got[got.score > 0.9]  # scores mean what they say
    assert abs(low.toxic.mean() - low.score.mean()) < 0.02 and abs(high.toxic.mean() - high.score.mean()) < 0.05


def test_weights_are_chosen_on_training_rows():
    found = weights_by_folds.main()
    assert min(found, key=lambda w: found[w][-1]) == (T.LEAST_WEIGHT, T.FULL_G2, T.LIFT)


def test_labels_held_out_teach_nothing(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    other = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), T.FOLDS) == T.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert other.exceptAll(labels).count() > 5
    told = lambda some: sorted((r.doc_id, r.score, r.evidence) for r in T.toxicity(docs, some).collect())
    assert told(labels) == told(other)


def test_edge_cases(spark):
    docs = [(i, "you idiot " + w) if i % 2 else (i, "a fine day " + w) for i, w in enumerate(["one", "two", "three", "four"] * 20)]
    docs += [(900, None), (901, ""), (None, "you idiot"), (902, "IDIOT! " * 5000), (903, "nothing known"), (3, "you idiot four"), (3, "you idiot four")]
    df = spark.createDataFrame([(*r, 1, "x", 0.5, 0, "e", 1) for r in docs], "doc_id long, text string, label int, held_out string, score double, predicted int, evidence string, h int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = T.toxicity(df, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert got[902].predicted == got[None].predicted == 1 and got[900].evidence == got[901].evidence == []
    assert len({r.score for r in rows if r.doc_id == 3}) == 1 and sum(r.doc_id == 3 for r in rows) == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.toxicity(empty, labels).collect() == []
    none = T.toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.predicted for r in none} == {0}
