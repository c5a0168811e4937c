import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash_dedup as M
from lodestone.llm import rows as R
from lodestone.session import Scratch, table

from .brute import near_duplicates, shingles


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in M.near_duplicates(df).collect()}
    want = near_duplicates(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def varied(rng, base, share):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in base)


def test_whole_table_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == near_duplicates(rows)


def test_chains_and_borderline_pairs(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{g}x{i}" for i in range(rng.choice([8, 30, 150, 400]))]
        for k in range(14):
            rows.append((g * 100 + k, " ".join(base)))
            base = varied(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05])).split()
    rng.shuffle(rows)
    check(spark, rows)


def test_hub_that_is_not_linked_loses_no_link(spark):
    """Many texts share half their words with the least id, and some only with one another."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, " ".join(passage))]
    for g in range(10):
        own = passage + [f"g{g}w{i}" for i in range(20)]
        rows += [(1 + g * 5 + k, varied(rng, own, 0.01 * k)) for k in range(5)]
    check(spark, rows)


def mixed_family(g, rng):
    """Two linked texts of one passage, and hubs for all their buckets, parts of it that neither is linked with."""
    core = [f"f{g}c{i}" for i in range(254)]
    rows, turned = [], core * 2
    for s in range(0, 254, 5):
        other = [f"f{g}o{s}x{i}" for i in range(10)]
        rows += [" ".join(other + turned[s : s + 194 + k]) for k in (0, 1)]
    rng.shuffle(rows)
    return rows + [" ".join(core + [f"f{g}{side}{i}" for i in range(n)]) for side, n in (("h", 10), ("m", 20))]


def test_bounds_by_the_hub_lose_no_link(spark):
    rng = random.Random(7)
    check(spark, list(enumerate(t for g in range(4) for t in mixed_family(g, rng))))


def test_mixtures_of_few_passages(spark):
    rng = random.Random(11)
    passages = [[f"p{p}w{i}" for i in range(rng.choice([20, 40, 60]))] for p in range(9)]
    rows = []
    for i in range(260):
        took = [p[: rng.choice([len(p), len(p), len(p) * 3 // 4])] for p in passages[:8] if rng.random() < 0.6] or passages[8:]
        rows.append((i, " ".join(w for p in took for w in p)))
    check(spark, rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "é\x85x a b c d"), (8, "é\x85x a b c d"), (9, "word " * 3000), (10, "word " * 5)]
    check(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(empty).collect() == []
    assert M.drop_near_duplicates(empty).collect() == []


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = "a b c d e f g h"
    rows = [(1, text, 5, "x"), (1, text, 6, "y"), (None, text, 7, "z"), (2, None, 8, "k"), (2, None, 8, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, key string")
    got = M.near_duplicates(df).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3
    kept = M.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n) for r in kept.collect()) == [(1, text, 5), (2, None, 8), (2, None, 8)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (40, 500, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: max(1, n * 6 // 7)], rng.integers(0, 2**63, n // 7, dtype=np.uint64) * np.uint64(2)]))
        sig = M.signatures([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.25


def test_sketches_bound_similarity_from_above():
    """Pairs at the threshold, of all sizes that are sketched: none is further off than two thirds of the margin."""
    rng = np.random.default_rng(4)
    for n in (64, 90, 200, 600, 3000):
        sets = []
        for _ in range(150):
            u = rng.integers(0, 2**64, -(-n * 8 // 7), dtype=np.uint64)
            inter, side = len(u) * 3 // 4, (len(u) - len(u) * 3 // 4) // 2
            sets += [np.unique(u[: inter + side]), np.unique(np.concatenate([u[:inter], u[inter + side :]]))]
        s = M.sketches(sets)
        alike = (s[::2] == s[1::2]).mean(axis=1)
        true = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2])])
        assert (true - alike).max() < M.MARGIN * 2 / 3


def test_buckets_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 10)
    rng = random.Random(7)
    check(spark, list(enumerate(mixed_family(0, rng))))


def test_large_group_of_copies_and_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(600)] + [(i, varied(rng, base, 0.03)) for i in range(600, 1000)]
    check(spark, rows)


@pytest.mark.parametrize("text", ["A b C d e f", "a b c", "", None])
def test_set_sizes(text):
    assert len(M.shingle_set(text)) == len(shingles(text))


def test_scratch_is_used(spark):
    assert Scratch(spark, "x").root.startswith(spark.conf.get("spark.checkpoint.dir"))


def shuffled(spark):
    """Bytes of all shuffles so far."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_what_moves_is_little_more_than_the_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    size = docs.selectExpr("sum(octet_length(text)) AS n").first().n
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, old = shuffled(spark), spark.conf.get(key)
    spark.conf.set(key, "-1")  # as at size, where tables are too large to be sent to all tasks
    try:
        M.near_duplicates(docs).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set(key, old)
    assert shuffled(spark) - before < 1.6 * size


def test_members_left_out_of_a_part_have_no_link(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = [varied(rng, base, rng.choice([0.0, 0.01, 0.02, 0.05, 0.2])) for _ in range(60)]
    sets = [M.shingle_set(t) for t in texts]
    sketch = M.sketches(sets)
    asks = [i % 3 == 0 for i in range(60)]
    common = {"key": [1] * 60, "i": [0] * 60, "j": [0] * 60, "rid": list(range(60)), "label": list(range(60)), "asks": asks}
    part = M.pa.table(common | {"n": [len(s) for s in sets], "sketch": [x.tobytes() for x in sketch]})
    near = set(M._part_near(part).column("rid").to_pylist())
    share = lambda s, t: len(np.intersect1d(s, t)) / len(np.union1d(s, t))
    linked = {(a, b) for a in range(60) for b in range(60) if asks[a] and not asks[b] and share(sets[a], sets[b]) >= 0.75}
    assert linked and {x for pair in linked for x in pair} <= near and len(near) < 60


def joined_on(spark, name):
    """Rows that inner joins on a column of this name have made so far."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and re.search(rf"\[{name}#\d+L\], \[{name}#\d+L\], Inner", node.desc()):
                for metric in map(node.metrics().apply, range(node.metrics().size())):
                    value = values.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and value.isDefined():
                        total += int(value.get().replace(",", ""))
    return total


def test_joins_make_no_more_rows_than_there_are_classes(spark, monkeypatch):
    """A group of near copies, many of them linked with few others or none: each meets its sketch and its set once, however many parts there are."""
    monkeypatch.setattr(M, "PART", 10)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, varied(rng, base, rng.choice([0.01, 0.03, 0.06, 0.1]))) for i in range(240)]
    before = joined_on(spark, "rid")
    check(spark, rows)
    assert 0 < joined_on(spark, "rid") - before <= 2 * len(rows)


def test_a_large_group_meets_what_is_known_of_it_in_many_tasks(spark, monkeypatch):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    rows = spark.range(4000).selectExpr("if(id < 3000, 0, id) AS a", "id AS b")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        groups = rows.groupBy("a").count().withColumnRenamed("count", "size")
        met = R.with_group(rows, groups, ["a"], "b").select("a", "b", F.col("g.size").alias("size"), F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.a, r.b, r.size) for r in met) == sorted((0, i, 3000) if i < 3000 else (i, i, 1) for i in range(4000))
    assert max(Counter(r.task for r in met).values()) < 1000
