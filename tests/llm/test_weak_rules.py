import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import weak_rules as W
from lodestone.session import table

D = "/root/testdata/sf0.001"
WORDS = "[^\x20\x09-\x0d]+"


def counts(text):
    words, lines = re.findall(WORDS, text), [x for x in text.split("\n") if re.search(WORDS, x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def said(text):
    words = re.findall(WORDS, text)
    n, chars, symbols, dup, again = counts(text)
    lines = [x for x in text.split("\n") if re.search(WORDS, x)]
    letters = len(re.findall("[A-Za-z]", text))
    parts = {
        "symbols": (symbols, n), "repeats": (again, n), "stutter": (sum(a == b for a, b in zip(words, words[1:])), n), "lines": (dup, len(lines) * (len(lines) > 1)),
        "capitals": (len(re.findall("[A-Z]", text)), letters), "odd_words": (sum(bool(re.search(r"""[^A-Za-z0-9.,;:?!'"()\x80-\U0010ffff-]""", w)) for w in words), n),
        "exclamations": (text.count("!"), n), "long_words": (chars, n * (2 * letters >= chars)), "same_words": (n - len(set(words)), n),
    }
    out = []
    for name, (_, _, low, high) in W.RULES.items():
        a, b = parts[name]
        out.append(0 if b == 0 else 1 if 100 * a <= low * b else -1 if 100 * a > high * b else 0)
    return out


def qualities(votes):
    """Expectation maximisation document by document."""
    chance = [0.05 if -1 in v else 0.95 for v in votes]
    n, prior = len(votes), 0.03 * len(votes)
    for _ in range(500):
        share = (sum(chance) + prior / 2) / (n + prior)
        odds = [math.log(share / (1 - share))] * n
        for j in range(len(W.RULES)):
            part = {(c, v): sum((q if c else 1 - q) for q, x in zip(chance, votes) if x[j] == v) for c in (0, 1) for v in (1, -1)}
            good = (part[1, 1] + prior * 0.95) / (part[1, 1] + part[1, -1] + prior)
            bad = (part[0, -1] + prior * 0.3) / (part[0, 1] + part[0, -1] + prior)
            if good + bad > 1:
                add = {1: math.log(good / (1 - bad)), -1: math.log((1 - good) / bad), 0: 0.0}
                odds = [o + add[x[j]] for o, x in zip(odds, votes)]
        new = [1 / (1 + math.exp(-o)) for o in odds]
        moved, chance = max(abs(a - b) for a, b in zip(new, chance)), new
        if moved < 1e-10:
            break
    return chance


def check(got, rows):
    assert len(got) == len(rows)
    quality = qualities([said(t or "") for _, t in rows])
    want = []
    for (i, t), q in zip(rows, quality):
        n, *rest, again = counts(t or "")
        failed = n < 50 or 100 * again > 50 * n
        want.append((i, n, *rest, again, failed, not failed and q >= 0.5, round(q, 6), said(t or "").count(1), said(t or "").count(-1)))
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(((*r[:8], round(r[8], 6), *r[9:]) for r in map(tuple, got)), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in table(spark, D, "documents").select("doc_id", "text").collect()]


def test_whole_table_against_plain_rules_and_documents(spark, rows):
    check(W.query(spark, D).collect(), rows)


def test_odd_texts(spark):
    rng = random.Random(3)
    mixed = [(i, "".join(rng.choice("abAB é\n\t!#|. ") for _ in range(rng.choice([0, 1, 5, 60, 700])))) for i in range(80)]
    again = " ".join(["one two three four"] * 20)
    odd = [(100, None), (101, ""), (102, " \n\t "), (None, "x"), (None, "x"), (103, "a\x0bb\x0cc\rd"), (104, "é" * 5000), (105, "w " * 100_000), (106, again), (106, again), (107, "漢字" * 300), (108, "\n".join(["same line", "other", "same line"] * 30)), (109, "a b c a b c a"), (110, "a a a a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in mixed + odd], "doc_id long, text string, n_words int, kept string").repartition(3)
    got = W.judge(df)
    assert got.columns[:8] == ["doc_id", *W.COUNTS, "base_failed", "kept"]
    check(got.collect(), mixed + odd)
    assert W.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", range(2, 5))
def test_windows(size):
    rng = np.random.default_rng(1)
    for n in range(40):
        ids = rng.integers(0, 5, n)
        windows = Counter(tuple(ids[i : i + size]) for i in range(n - size + 1))
        inside = {i + j for i in range(n - size + 1) if windows[tuple(ids[i : i + size])] > 1 for j in range(size)}
        assert W.repeated(ids, 5, size) == len(inside)


def test_known_accuracies_are_found():
    """Votes drawn with known chances: the fit finds them, however many documents there are."""
    rng = np.random.default_rng(2)
    right = np.array([[0.95, 0.8], [0.9, 0.7], [0.97, 0.6], [0.85, 0.9], [0.99, 0.5], [0.9, 0.9], [0.95, 0.75], [0.9, 0.6], [0.92, 0.8]])
    good = rng.random(40_000) < 0.8
    correct = rng.random((40_000, 9)) < np.where(good[:, None], right[:, 0], right[:, 1])
    vote = np.where(correct == good[:, None], W.GOOD, W.BAD) * (rng.random((40_000, 9)) < 0.8)
    patterns, n = np.unique(vote @ 3 ** np.arange(9), return_counts=True)
    chance, rates = W.posteriors(patterns, n.astype(float), held=1e-4)
    assert np.abs(rates - right).max() < 0.04
    more, again = W.posteriors(patterns, n * 1000.0, held=1e-4)
    assert np.allclose(chance, more) and np.allclose(rates, again)
    told = dict(zip(patterns.tolist(), chance >= 0.5))
    assert np.mean([told[p] == g for p, g in zip((vote @ 3 ** np.arange(9)).tolist(), good)]) > 0.97


def test_a_corpus_without_bad_documents_stays(spark):
    d = "/root/testdata/sf0.01"
    good = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    assert W.judge(good).where("not kept and not base_failed").count() == 0


def test_held_against_labels(spark):
    """No label is used; of documents that the base rules let pass, those labelled good stay and most of those labelled bad go."""
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels").withColumnRenamed("quality", "label")
    judged = W.query(spark, d).where("not base_failed").join(labels, "doc_id").select("label", "kept").collect()
    share = {label: np.mean([r.kept for r in judged if r.label == label]) for label in (0, 1)}
    assert share[1] > 0.995 and share[0] < 0.05
