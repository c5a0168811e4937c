"""Toxicity by the nearest labelled examples.

A text's vector is the TF-IDF of all its terms that the examples have. Terms count in full where their presence goes
with label 1, by a likelihood-ratio test over all labelled documents, and LEAST_WEIGHT of it otherwise: in plain TF-IDF
the many words that say nothing of toxicity hide the few that do. Examples are indexed by term, in blocks of
examples alike. Short lists are added up for all examples; of the long lists each block has its highest
weights, and a block is scored only where these and its best sum of short lists may reach the k-th
cosine found. So the nearest examples are exact. They vote by distance, and are the evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestone.session import Scratch, table

from .filters import hash_filter, passing
from .folds import fold
from .units import chunks, coded, raw_bytes, split
from .workers import tidy

FOLDS, HELD_OUT = 5, 0
#: A term's weight grows with G-squared up to FULL_G2 if its documents have label 1 LIFT times as often as others; it never is less than LEAST_WEIGHT.
#: Of the numbers compared in tests/llm/weights_by_folds.py these have the least log loss, by folds within the rows that aren't held out.
LEAST_WEIGHT, FULL_G2, LIFT = 0.02, 200.0, 2.0
#: Labelled rows that are indexed, taken in order of a hash of their id: at most so many rows, and bytes in all.
MAX_EXAMPLES, MAX_BYTES = 3_000, 24_000_000
BLOCK = 32
#: Blocks that are scored before others are ruled out.
FIRST = 2
#: Lists of more than this share of the examples are long.
LONG = 1 / 16
#: Texts that are held against the index at a time, and entries of short lists that these may meet.
TEXTS, ENTRIES = 256, 4_000_000
NEIGHBOURS = 15
#: The base rate votes with this weight.
PRIOR = 0.5
CHUNK = 6_000_000
UNIT, WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+"), re.compile(r"[^\W_]+")
_IN_UNIT = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_JOINED = (_IN_UNIT[:, None] == _IN_UNIT[None, :]).ravel()
_EVIDENCE = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])


def terms(text: str | None) -> list[str]:
    return [t for u in UNIT.findall(text or "") for t in WORD.findall(u.lower())]


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, term, times) for each distinct term of each text, in this order, and the terms by number. texts are without null."""
    data, at = raw_bytes(texts)
    data = _LOWER[data]
    begins, sizes = split(data, at, _JOINED)
    codes, distinct = coded(data, begins)
    raw, ends = raw_bytes(distinct)
    has, wide = (np.zeros(len(distinct), bool),) * 2
    if len(distinct):
        has = _IN_UNIT[raw[ends[:-1]]]
        wide = has & (np.maximum.reduceat(raw, ends[:-1]) >= 0x80)
    # A unit of ASCII letters and digits is a term; what terms others hold is found one by one.
    names = distinct.filter(pa.array(has & ~wide)).cast(pa.large_string())
    own = [terms(u) for u in distinct.filter(pa.array(wide)).cast(pa.large_string()).to_pylist()]
    other = pa.array([t for ts in own for t in ts], pa.large_string()).dictionary_encode()
    known = pc.index_in(other.dictionary, value_set=names)
    fresh = known.is_null().to_numpy(zero_copy_only=False)
    number = known.fill_null(0).to_numpy().astype(np.int64)
    number[fresh] = len(names) + np.arange(np.count_nonzero(fresh))
    many = (has & ~wide).astype(np.int64)
    many[wide] = [len(ts) for ts in own]
    start = np.cumsum(many) - many
    flat = np.empty(int(many.sum()), np.int64)
    flat[start[has & ~wide]] = np.arange(len(names))
    flat[np.repeat(wide, many)] = number[other.indices.to_numpy()]
    times = many[codes]
    text = np.repeat(np.repeat(np.arange(len(texts)), sizes), times)
    within = np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
    term = flat[np.repeat(start[codes], times) + within]
    names = pa.concat_arrays([names, other.dictionary.filter(pa.array(fresh))])
    key, n = np.unique(text * max(1, len(names)) + term, return_counts=True)
    return key // max(1, len(names)), key % max(1, len(names)), n, names


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return chunks(pc.binary_length(texts).to_pylist(), CHUNK)


@tidy
def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (term, n, n1): documents of a part of the table with the term, and those labelled 1."""
    for batch in batches:
        texts, label = batch.column("text").fill_null(""), batch.column("label").to_numpy()
        for a, b in _parts(texts):
            text, term, _, names = occurrences(texts.slice(a, b - a))
            n = np.bincount(term, minlength=len(names))
            n1 = np.bincount(term[label[a:b][text] == 1], minlength=len(names))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n, pa.int64()), pa.array(n1, pa.int64())], ["term", "n", "n1"])


def weight_of(n, n1, all_, ones):
    """The weights of terms by how many documents have them, and how many of these label 1; of all_ documents, ones have it."""
    n, n1 = np.asarray(n, float), np.asarray(n1, float)
    rate = ones / all_

    def part(observed, expected):
        return np.where((observed > 0) & (expected > 0), observed * np.log(np.maximum(observed, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    rest = all_ - n
    g2 = 2 * (part(n1, n * rate) + part(n - n1, n * (1 - rate)) + part(ones - n1, rest * rate) + part(rest - ones + n1, rest * (1 - rate)))
    others = (ones - n1) / np.maximum(rest, 1)
    tells = np.where(n1 / n > LIFT * others, np.clip(g2 / FULL_G2, 0, 1), 0.0)
    return np.log(1 + all_ / n) * np.maximum(tells, LEAST_WEIGHT)


class Index:
    """Block-max inverted index of example vectors: rows (example, term, weight) in unit vectors, each pair once."""

    def __init__(self, ids: list[int], labels: list[int], example: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int):
        n = len(ids)
        strongest = np.full(n, size, np.int64)
        if len(example):  # alike ones share blocks: those with the same strongest term
            by = np.lexsort((term, -weight, example))
            first = by[np.concatenate([[True], np.diff(example[by]) > 0])]
            strongest[example[first]] = term[first]
        order = np.lexsort((np.array(ids, np.int64), strongest)) if n else np.empty(0, np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels = np.array(ids, np.int64)[order], np.array(labels, np.int64)[order]
        self.blocks = -(-n // BLOCK)
        self.n = self.blocks * BLOCK
        row = place[example]
        length = np.bincount(term, minlength=size)
        long = np.flatnonzero(length > max(LONG * n, 1))
        self.at_long = np.full(size, -1, np.int64)
        self.at_long[long] = np.arange(len(long))
        self.table = np.zeros((len(long), self.n))
        dense = self.at_long[term] >= 0
        self.table[self.at_long[term[dense]], row[dense]] = weight[dense]
        self.top = self.table.reshape(len(long), self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((len(long), 0))
        row, term, weight = row[~dense], term[~dense], weight[~dense]
        by = np.lexsort((row, term))
        self.row, self.weight = row[by], weight[by]
        self.start = np.searchsorted(term[by], np.arange(size + 1))

    def nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine): the k examples of highest cosine above 0 of each text, nearest first; of equal ones the earlier.

        (text, term, weight) are the entries of the texts' unit vectors, by text. Cosines are held to 12 digits.
        """
        if not self.blocks or not len(text):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        met = np.where(self.at_long[term] < 0, self.start[term + 1] - self.start[term], 0)
        cost = np.bincount(text, met, minlength=texts).astype(np.int64) + ENTRIES // TEXTS
        found = []
        for a, b in chunks(cost.tolist(), ENTRIES):
            part = slice(*np.searchsorted(text, [a, b]))
            t, e, c = self._batch(text[part] - a, term[part], weight[part], met[part], b - a, k)
            found.append((t + a, e, c))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _batch(self, text, term, weight, met, texts, k):
        total = int(met.sum())
        at = np.repeat(self.start[term], met) + np.arange(total) - np.repeat(np.cumsum(met) - met, met)
        score = np.bincount(np.repeat(text, met) * self.n + self.row[at], self.weight[at] * np.repeat(weight, met), minlength=texts * self.n).astype(float).reshape(texts, self.n)
        q = np.zeros((texts, len(self.table)))
        long = self.at_long[term] >= 0
        q[text[long], self.at_long[term[long]]] = weight[long]
        bound = q @ self.top + score.reshape(texts, self.blocks, BLOCK).max(axis=2)
        open_ = np.zeros(bound.shape, bool)
        first = min(FIRST, self.blocks)
        np.put_along_axis(open_, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        self._score(score, q, open_)
        held = score.reshape(texts, self.blocks, BLOCK)[open_].reshape(texts, first * BLOCK)
        floor = np.partition(held, first * BLOCK - k, axis=1)[:, first * BLOCK - k] if first * BLOCK >= k else np.zeros(texts)
        more = ~open_ & (bound >= floor[:, None] - 1e-9) & (bound > 0)
        self._score(score, q, more)
        score[~np.repeat(open_ | more, BLOCK, axis=1)] = 0.0
        # Whole numbers that differ, in order of the cosine, then of the example.
        rank = np.rint(score * 1e12).astype(np.int64) * self.n + (self.n - 1 - np.arange(self.n))
        k = min(k, self.n)
        best = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(rank, best, axis=1), axis=1), axis=1)
        cosine = np.round(np.take_along_axis(score, best, axis=1), 12)
        i, j = np.nonzero(cosine > 0)
        return i, best[i, j], cosine[i, j]

    def _score(self, score: np.ndarray, q: np.ndarray, open_: np.ndarray) -> None:
        """Adds the long lists' part of the open blocks."""
        if not q.shape[1]:
            return
        if open_.mean() > 0.5:
            score += np.where(np.repeat(open_, BLOCK, axis=1), q @ self.table, 0.0)
            return
        for b in np.flatnonzero(open_.any(axis=0)).tolist():
            own = np.flatnonzero(open_[:, b])
            score[own, b * BLOCK : (b + 1) * BLOCK] += q[own] @ self.table[:, b * BLOCK : (b + 1) * BLOCK]


def votes(text: np.ndarray, cosine: np.ndarray, label: np.ndarray, texts: int, rate: float) -> np.ndarray:
    """For each text the share of label 1 by weights that fall with distance, with the base rate as one more vote."""
    w = cosine / (1.05 - np.minimum(cosine, 1.0))
    return (PRIOR * rate + np.bincount(text, w * label, minlength=texts)) / (PRIOR + np.bincount(text, w, minlength=texts))


class Model:
    """The vocabulary with its weights, the index and the base rate."""

    def __init__(self, names: pa.Array, weight: np.ndarray, rate: float):
        self.names, self.weight, self.rate, self.index = names, weight, rate, None

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries (text, term, weight) of the texts' unit vectors, by text."""
        text, term, n, names = occurrences(texts)
        term = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)[term]
        held = term >= 0
        text, term, n = text[held], term[held], n[held]
        w = (1 + np.log(n)) * self.weight[term] if len(term) else np.empty(0)
        norm = np.sqrt(np.bincount(text, w * w, minlength=len(texts)))
        return text, term, w / norm[text]

    def nearest(self, texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.index.nearest(*self.vectors(texts), len(texts), k)


def train(labelled: DataFrame, limit: int = MAX_EXAMPLES, most: int = MAX_BYTES) -> Model:
    """A model from labelled (doc_id, text, label). Statistics are over all rows; the index holds a sample, bounded by rows and bytes."""
    spark = labelled.sparkSession
    size = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1")).first()
    if not size.n:
        model = Model(pa.array([], pa.large_string()), np.empty(0), 0.0)
        model.index = Index([], [], *(np.empty(0, np.int64),) * 2, np.empty(0), 0)
        return model
    chosen, total = [], 0
    for r in labelled.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(limit).collect():
        total += r.size
        if total > most and chosen:
            break
        chosen.append(r.doc_id)
    # The sample's texts are at most MAX_BYTES, or one text.
    rows = labelled.where(F.col("doc_id").isin(chosen)).select("doc_id", "label", "text").toArrow().sort_by("doc_id").combine_chunks()
    texts = rows.column("text").combine_chunks().fill_null("")
    names = sorted({t for a, b in _parts(texts) for t in occurrences(texts.slice(a, b - a))[3].to_pylist()})
    counts = labelled.select("text", "label").mapInArrow(_presence, "term string, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    wanted = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string())}))
    found = counts.join(wanted, "term", "left_semi").orderBy("term").toArrow()
    weight = weight_of(found.column("n").to_numpy(), found.column("n1").to_numpy(), float(size.n), float(size.n1))
    model = Model(found.column("term").combine_chunks().cast(pa.large_string()), weight, float(size.n1) / float(size.n))
    entries = [(t + a, *rest) for a, b in _parts(texts) for t, *rest in [model.vectors(texts.slice(a, b - a))]]
    example, term, w = (np.concatenate(x) for x in zip(*entries, strict=True))
    model.index = Index(rows.column("doc_id").to_pylist(), rows.column("label").to_pylist(), example, term, w, len(weight))
    return model


def _scorer(sent, k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index = model.index
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for a, b in _parts(texts):
                text, example, cosine = model.nearest(texts.slice(a, b - a), k)
                label = index.labels[example] if len(example) else np.empty(0, np.int64)
                score = votes(text, cosine, label, b - a, model.rate)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b - a))])
                ids = index.ids[example] if len(example) else np.empty(0, np.int64)
                told = pa.StructArray.from_arrays([pa.array(ids), pa.array(cosine, pa.float64()), pa.array(label, pa.int32())], fields=list(_EVIDENCE))
                evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")), pa.array(score), evidence], ["doc_id", "held_out", "score", "evidence"])

    return run


def labelled_texts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, label) of the documents to learn from, one for each text. Of labels that differ for an id or a text, 1 wins.

    Copies would make all words of a text seem to go with its label; they are found by hash. A filter of bounded size keeps
    back the texts of other ids before any text moves.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    hashed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    first = hashed.join(known.hint("merge"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    first = scratch.save(first.select("doc_id", "h", "label", F.xxhash64("doc_id").alias("id_key")), "first")
    sent = spark.sparkContext.broadcast(hash_filter(first, "id_key"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.xxhash64(F.col("doc_id").cast("long")).alias("id_key"), "text")
    texts = texts.mapInArrow(passing(sent), "doc_id long, h long, id_key long, text string").drop("id_key")
    # Rows that repeat in id and text are one.
    return texts.join(first.drop("id_key").hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "label")


def toxicity(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of docs (doc_id, text, ...).

    labels (doc_id, toxic) teaches from the ids that aren't held out. evidence lists the nearest
    examples, nearest first. Texts without a term of the examples, empty and null ones included, have no
    neighbour and score the base rate; so do all texts where nothing could be learned, at rate 0. A
    null doc_id teaches nothing. Rows that repeat are scored alike. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    labelled = scratch.save(labelled_texts(docs, labels, scratch), "labelled")
    sent = spark.sparkContext.broadcast(train(labelled))
    scratch.drop(labelled)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text").mapInArrow(
        _scorer(sent, neighbours), f"doc_id {kind}, held_out boolean, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>"
    )
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
