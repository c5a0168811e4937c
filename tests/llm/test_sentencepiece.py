import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import lattice as L, token_counts as C, units as U
from lodestone.session import table

ODD = ["", " ", "a▁b", " x▁a", "  two  spaces ", "日本語\U0001f600\n\t", "▁", "é" * 10, "\x00x", "", "a▁b", "x" * 3000, "word " * 4000, "\r\n tab\t"]


def encoded(texts, keys, of):
    ids, cut, _, _ = L.encode_batch(pa.array(texts, pa.string()), [str(k).encode() for k in keys], of)
    return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@pytest.fixture(scope="module")
def of():
    return L.pieces(L.MODEL)


def segmentations(word, of):
    """Every way to cut the characters of a word into pieces or bytes, with its weight."""
    if not word:
        yield (), 0.0
    for n in range(1, len(word) + 1):
        head = word[:n]
        if head in of.ids:
            ids, w = (of.ids[head],), of.log[head]
        elif n == 1:
            raw = head.encode()
            ids, w = tuple(of.byte[b] for b in raw), len(raw) * of.byte_log
        else:
            continue
        for rest, v in segmentations(word[n:], of):
            yield ids + rest, w + v


def test_round_trip_of_odd_texts(of):
    assert [L.decode(x, of) for x in encoded(ODD, range(len(ODD)), of)] == ODD


def test_samples_follow_the_weights(of):
    word = "▁thens"
    ways = dict(segmentations(word, of))
    total = sum(math.exp(w) for w in ways.values())
    n = 20000
    got = Counter(tuple(x.tolist()) for x in encoded(["thens"] * n, range(n), of))
    assert set(got) <= set(ways)
    for ids, w in ways.items():
        p = math.exp(w) / total
        assert abs(got[ids] / n - p) < 5 * math.sqrt(p / n) + 1e-3


def test_same_key_same_ids_in_any_batch(of):
    texts = ["the cat sat", "on the mat, on the mat", "the cat sat"]
    keys = [1, 2, 3]
    whole = encoded(texts, keys, of)
    alone = [encoded([t], [k], of)[0] for t, k in zip(texts, keys, strict=True)]
    assert all((a == b).all() for a, b in zip(whole, alone, strict=True))
    more = [encoded(["on the mat, on the mat"], [k], of)[0].tobytes() for k in range(30)]
    assert len(set(more)) > 5


def test_long_units_as_short_ones(of, monkeypatch):
    texts = ["internationalisation" * 4, "thethethe", "é☃é" * 20, "a" * 70, "", "日本" * 30]
    short = encoded(texts, range(len(texts)), of)
    counts = C.count_batch(pa.array(texts), of)[1].tolist()
    monkeypatch.setattr("lodestone.llm.units.LONG", 6)
    long = encoded(texts, range(len(texts)), of)
    assert all(np.array_equal(a, b) for a, b in zip(short, long, strict=True))
    assert C.count_batch(pa.array(texts), of)[1].tolist() == counts == [plain_count(t, of) for t in texts]


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    a = sorted(L.query(spark, "/root/testdata/sf0.001").collect())
    b = sorted(L.encode_digests(docs.repartition(7)).collect())
    ids = {r.doc_id: r.ids for r in L.encode(docs).collect()}
    assert all(len(ids[r.doc_id]) == r.n_ids for r in a)
    assert a == b and len(a) == docs.count() and all(r.lossless for r in a)


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, None, 3, "x"), (None, "a b", 4, "y"), (None, "a b", 5, "z"), (2, "", 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = L.decode_rows(L.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == [(0, "a b"), (0, "a b"), (1, ""), (2, "")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.decode_rows(L.encode(empty)).collect() == [] and C.token_counts(empty).collect() == []
    for name in ("n_tokens", "n_pretokens"):
        counted = C.token_counts(df.withColumnRenamed("ids", name)).collect()
        assert sorted(((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in counted)) == [(0, 2, 2), (0, 2, 2), (1, 1, 1), (2, 1, 1)]
    again = L.encode_digests(df.where("doc_id is null")).collect()
    assert again[0] == again[1]


def viterbi(word, of):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - of.longest), end):
            t = word[start:end]
            if t in of.ids:
                options.append((best[start][0] + of.log[t], best[start][1] + 1))
            elif start == end - 1:
                n = len(t.encode())
                options.append((best[start][0] + n * of.byte_log, best[start][1] + n))
        top = max(o[0] for o in options)
        best.append((top, min(o[1] for o in options if o[0] == top)))
    return best[-1][1]


def plain_count(text, of):
    s = L.SPACE + text.replace(" ", L.SPACE)
    return viterbi(s, of)


def test_counts_against_one_dynamic_program_over_each_text(spark, of):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in C.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    longest = max(docs, key=lambda r: len(r.text))
    assert len(longest.text) > 5000
    for r in [*itertools.islice((r for r in docs if len(r.text) < 1500), 60), longest]:
        assert got[r.doc_id] == plain_count(r.text, of)


def test_trie_shares_prefixes(of):
    trie = U.Trie(pa.array([b" walk", b" walks", b" walking"], pa.binary()))
    for _, options in trie.levels(of.table):
        list(options)
    assert trie.size == 1 + len(" walking") + 1
    texts = [t for t in ODD if "▁" not in t]
    assert C.count_batch(pa.array(texts), of)[1].tolist() == [plain_count(t, of) for t in texts]
    assert C.count_batch(pa.array([""]), of)[0].tolist() == [1]


def test_no_piece_goes_across_a_cut(of):
    texts = ["one, two; three... (four)\n\nfive 66 é, ü-ü", "a  b   c "]
    data, at = U.raw_bytes(pa.array(texts))
    begins, sizes = U.split(data, at, of.joined)
    assert sizes.sum() == len(begins) > 10
    for t in itertools.islice(of.ids, 4000):
        raw = t.replace(L.SPACE, " ").encode()
        for a in range(len(data) - len(raw) + 1):
            if data[a : a + len(raw)].tobytes() == raw and not ((at > a) & (at < a + len(raw))).any():
                assert not ((begins > a) & (begins < a + len(raw))).any()


def test_no_draw_is_outside(of):
    la = L.Lattices(of, pa.array([b" thens"], pa.binary()))
    ids, count = la.sample(np.zeros(1000, np.int64), np.arange(1000, dtype=np.uint64))
    assert count.sum() == len(ids) and (ids > 0).all()
