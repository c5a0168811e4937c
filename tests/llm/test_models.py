import math
import zlib
from collections import Counter
from functools import cache

import numpy as np

from lodestone.llm import language_id as L, quality as Q, topk as T
from lodestone.session import Scratch, table


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = L.query(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.98


def plain_languages(rows):
    """rows (doc_id, text, lang): {doc_id: ([(share of n-grams, language)] in order of preference)}, from sets of strings."""

    def strings(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        line = f" {' '.join(words)} "
        return [line[i : i + n] for n in L.ORDERS for i in range(len(line) - n + 1)] if words else []

    counts = {}
    for i, t, g in rows:
        if g is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(g, Counter()).update(strings(t))
    totals = {g: c.total() for g, c in counts.items() if c}
    share = {g: {s: n / totals[g] for s, n in counts[g].items()} for g in totals}
    most = Counter()
    for own in share.values():
        for s, x in own.items():
            most[s] = max(most[s], x)
    member = {g: {s for s, x in own.items() if x >= L.FLOOR and x >= L.RATIO * most[s]} for g, own in share.items()}
    out = {}
    for i, t, _ in rows:
        all_ = strings(t)
        out[i] = sorted(((sum(s in member[g] for s in all_) / len(all_), g) for g in member), key=lambda x: (-x[0], -totals[x[1]], x[1])) if all_ else []
    return out


def test_language_against_plain_version(spark):
    """The whole query: counts, members, votes and verdicts. The filters' false positives leave a small difference."""
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, d, "documents").collect()]
    want, got = plain_languages(rows), {r.doc_id: r for r in L.query(spark, d).collect()}
    assert set(got) == set(want)
    for i, t, _ in rows:
        if not want[i]:
            assert (got[i].lang_pred, got[i].score) == (L.UNKNOWN, 0.0)
            continue
        (best, lang), *others = want[i]
        near = 0.01 + 2 / len(t) ** 0.5  # the corrected count of few n-grams varies more
        told = dict((g, x) for x, g in want[i])
        assert abs(got[i].score - told[got[i].lang_pred]) < near, i
        assert got[i].lang_pred == lang or best - told[got[i].lang_pred] < near, i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert sum(got[i].lang_pred == w[0][1] for i, w in want.items() if w) >= 0.99 * len(rows)


def test_language_ties_and_repeats(spark):
    """Languages that say the same: the one with most n-grams, then the first by name. Rows that repeat are told alike."""
    rows = [(i, "one two three", g) for i in range(40) for g in ("xx", "aa", "mm")] + [(i, "one two three", "xx") for i in range(8)]
    got = L.identify(spark.createDataFrame([r for r in rows if r[2] != "xx"], "doc_id long, text string, lang string")).collect()
    assert len(got) == 80 and {r.lang_pred for r in got} == {"aa"}
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {(r.lang_pred, r.score) for r in got} == {("xx", got[0].score)}


def test_filters_hold_what_they_were_given():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    member = rng.random((5000, 11)) < 0.3
    f = L.Filters([f"l{i}" for i in range(11)], keys, member)
    bits = np.unpackbits(f.languages(keys), axis=1, bitorder="little")[:, :11].astype(bool)
    assert (bits | ~member).all() and (bits & ~member).mean() < 0.03
    others = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    assert f.counts(others).max() < 400


def test_language_edge_cases(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 ++", "en"), (103, "the dog " * 20000, None), (None, "die katze", None), (104, "日本", "en")]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und"
    assert got[103].lang_pred == "en" and got[None].lang_pred == "de"
    kept = L.drop_unidentified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {103, None, 0, 1} and 100 not in {r.doc_id for r in kept.collect()}
    empty = df.where("false")
    assert L.identify(empty).collect() == [] and L.drop_unidentified(empty).collect() == []
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", df.lang.substr(0, 0).cast("string")).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_language_stage_drops_languages_that_were_not_learned(spark):
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    rng = np.random.default_rng(2)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 600)) for _ in range(20)]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    strange = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate([finnish, polish, *noise])], docs.schema)
    kept = {r.doc_id for r in L.drop_unidentified(docs.unionByName(strange)).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("length(text) > 200").collect()}
    assert not any(i >= 10_000_000 for i in kept) and len(clean - kept) <= len(clean) // 500


def plain_kneser_ney(texts, order):
    """p(gram) from the formula, for tuples of bytes."""
    counts = {order: {}}
    for t in texts:
        padded = [0] * (order - 1) + list(t)
        for i in range(len(t)):
            g = tuple(padded[i : i + order])
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, off = {}, {}
    for k, c in counts.items():
        d = Q.discounts(Counter(c.values()))
        for g, n in c.items():
            total[k, g[:-1]] = total.get((k, g[:-1]), 0) + n
            off[k, g[:-1]] = off.get((k, g[:-1]), 0) + d[min(n, 3) - 1]
        off[k] = d

    @cache
    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        if (k, g[:-1]) not in total:
            return p(g[1:])
        n, all_ = counts[k].get(g, 0), total[k, g[:-1]]
        return (n - off[k][min(n, 3) - 1] if n else 0) / all_ + off[k, g[:-1]] / all_ * p(g[1:])

    return p


def plain_loss(p, text, order):
    padded = (0,) * (order - 1) + tuple(text)
    return -sum(math.log(p(padded[i : i + order])) for i in range(len(text)))


def test_model_against_its_formula(spark):
    texts = ["abcab abca", "bca abc", "aab", "cab cab cab", "日本 é"]
    pressed = spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string").mapInArrow(Q._press, "pressed binary")
    p = plain_kneser_ney([t.encode() for t in texts], 3)
    asked = [*texts, "", None, "xyz", "cabby ca", "\0a", "日é" * 50]
    docs = spark.createDataFrame([(i, i, "", t) for i, t in enumerate(asked)], "doc_id long, text_key long, lang string, text string").repartition(2)
    for block in (1, 40, 10**6):
        model = Q.train(pressed, Scratch(spark, "kn"), order=3)
        got = {r.doc_id: r for r in Q.losses(docs, model, Scratch(spark, "kn"), 3, block).collect()}
        assert len(got) == len(asked)
        for i, t in enumerate(asked):
            assert got[i].n_symbols == len((t or "").encode())
            assert math.isclose(got[i].loss, plain_loss(p, (t or "").encode(), 3), rel_tol=1e-4, abs_tol=1e-6), t
    for context in ((97, 98), (0, 0), (120, 121)):
        assert math.isclose(sum(p((*context, w)) for w in range(256)), 1, abs_tol=1e-9)


def test_quality_against_plain_version(spark):
    """The whole query: model, perplexity, quantiles by language, and verdicts."""
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, (r.text or "").encode(), r.lang or "") for r in table(spark, d, "documents").collect()]
    least = {}
    for r in table(spark, d, "labels").collect():
        least[r.doc_id] = min(least.get(r.doc_id, 2), 2 if r.quality is None else r.quality)
    of = lambda i: zlib.crc32(str(i).encode()) % Q.FOLDS
    p = plain_kneser_ney([t for i, t, _ in docs if least.get(i) == 1 and of(i) != Q.KEPT_BACK], Q.ORDER)
    loss = {i: plain_loss(p, t, Q.ORDER) for i, t, _ in docs}
    back = [(i, t, g) for i, t, g in docs if least.get(i) == 1 and of(i) == Q.KEPT_BACK and t]
    mean = lambda rows: sum(loss[i] for i, *_ in rows) / sum(len(t) for _, t, _ in rows)
    langs = {g for *_, g in back}
    means = {g: mean([r for r in back if r[2] == g]) for g in langs}
    perplexity = {i: math.exp((loss[i] + Q.PRIOR * means.get(g, mean(back))) / (len(t) + Q.PRIOR)) for i, t, g in docs}

    def cut(rows):
        own = sorted(perplexity[i] for i, *_ in rows)
        return own[math.ceil(Q.QUANTILE * len(own)) - 1] * Q.SLACK

    cuts = {g: cut([r for r in back if r[2] == g]) for g in langs if sum(r[2] == g for r in back) >= Q.LEAST}
    got = {r.doc_id: r for r in Q.query(spark, d).collect()}
    assert set(got) == set(loss)
    for i, t, g in docs:
        threshold = cuts.get(g, cut(back))
        assert math.isclose(got[i].perplexity, perplexity[i], rel_tol=1e-4) and math.isclose(got[i].threshold, threshold, rel_tol=1e-4)
        assert got[i].kept == (len(t) > 0 and perplexity[i] <= threshold) or abs(perplexity[i] / threshold - 1) < 1e-4


def test_quality_keeps_trusted_and_drops_junk(spark):
    d = "/root/testdata/sf0.1"
    got = Q.query(spark, d).join(table(spark, d, "labels"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.995 and got[got.quality == 0].kept.mean() < 0.15


def test_quality_edge_cases(spark):
    rows = [(i, "a fine day it is", "en") for i in range(40)] + [(50, None, "en"), (51, "", None), (None, "ZZ## !!", None), (52, "a fine day " * 9000, "en")]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, perplexity double, kept boolean")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 1), (31, None)], "doc_id long, quality int")
    got = Q.rate(df, labels).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got if r.doc_id in (50, 51))
    kept = Q.drop_low_quality(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(range(40))
    assert Q.rate(df.where("false"), labels).collect() == [] and Q.drop_low_quality(df.where("false"), labels).collect() == []
    assert all(r.kept for r in Q.rate(df, labels.where("false")).collect() if r.doc_id is not None and r.doc_id < 50)


def plain_topk(vectors, queries, k):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in whole:
            s = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=False)), i) for i in whole if i != q)[:k]
            out += [(q, n, i, -v) for n, (v, i) in enumerate(s, 1)]
    return sorted(out)


def test_topk_against_all_products(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[i][1]) for i in range(20)]
    vectors += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [math.nan] * 8), (403, [math.inf] + [0.0] * 7), (404, [0.0] * 8), (405, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, x int, rank int")
    for block, k in ((64, 10), (4096, 3), (7, 500)):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.exact_topk(df, df.where("vec_id % 20 = 0"), k, block=block).collect())
        assert got == plain_topk(vectors, [i for i, _ in vectors if i % 20 == 0], k)
    assert T.exact_topk(df.where("false"), df, 3).collect() == [] and T.exact_topk(df, df.where("false"), 3).collect() == []


def test_topk_rows_that_repeat(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.2, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in T.exact_topk(df, df.where("vec_id = 3"), 3).collect())
    assert got == [(3, 1, 1), (3, 2, 1), (3, 3, 2)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in T.exact_topk(df, df.where("vec_id = 1").dropDuplicates(), 3).collect())
    assert got == [(1, 1, 2), (1, 2, 2), (1, 3, 3)]


def test_topk_skips_blocks_of_short_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(size=8) * 0.9**i).tolist()) for i in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(1)
    seen, plain = [], T.open_pairs

    def spy(asked, blocks):
        out = plain(asked, blocks)
        seen.append((asked.count() * blocks.count(), out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(T, "open_pairs", spy)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.exact_topk(df, df.where("vec_id < 40"), 2, block=16).collect())
    assert got == plain_topk(vectors, range(40), 2)
    every, met, distinct = seen[0]
    assert met == distinct and 0 < met < every / 2
    assert T.least_length(np.zeros((1, 2)), np.zeros(1)) == -np.inf and T.least_length(np.ones((2, 2)), np.array([5.0, -np.inf])) == -np.inf
