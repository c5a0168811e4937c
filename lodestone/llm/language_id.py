"""Language identification with bit-sliced Bloom filters over character n-grams.

Training counts the n-grams of every labelled text by language. A language contains an n-gram if
it makes up at least FLOOR of the language's n-grams and at least RATIO of its share in the language
where it is most frequent. As shares add up to one, a language has at most 1 / FLOOR n-grams, which
bounds the filter. Row p of the filter has a bit for each language, so the AND of an n-gram's rows is
the set of all languages that contain it. A text's bits are counted by language and corrected
for the filter's false positives; the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import Scratch, table

from .folds import fold
from .rows import unused
from .workers import tidy

ORDERS = (3, 4)
FLOOR = 1e-5
RATIO = 0.3
HASHES = 2
#: Rows of the filter for each n-gram in it.
SPARSITY = 16
CHUNK = 1_000_000
UNKNOWN = "und"
#: The filtering stage drops documents of no language, and those of which fewer n-grams belong to the predicted one.
#: Letter noise scores about as much; where held-out documents tell what clean text scores, the cut is higher.
LEAST_SCORE = 0.05
#: The cut of a language is this quantile of the scores of its held-out documents, times SLACK: short clean texts score
#: less than most, but languages that were not learned score less still.
QUANTILE, SLACK = 0.01, 0.4
#: Languages with fewer held-out documents use the cut of all languages.
LEAST = 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Hashes of the character n-grams of the lower-cased text; each run of other characters than letters is one space."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    first_gap = ~letter
    first_gap[1:] &= letter[:-1]
    first_gap[0] = False
    symbols = np.where(letter, points, 32)[letter | first_gap]
    symbols = np.concatenate([[32], symbols, [32] if symbols[-1] != 32 else []]).astype(np.uint64)
    out = []
    for n in ORDERS:
        h = np.full(max(len(symbols) - n + 1, 0), n, np.uint64)
        for j in range(n):
            h *= np.uint64(0x100000001B3)
            h += symbols[j : j + len(h)]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out)


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n): the counts of a partition."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def fold_in(lang: str) -> None:
        if waiting.get(lang):
            held.setdefault(lang, []).append(np.unique(np.concatenate(waiting.pop(lang)), return_counts=True))
            sizes[lang] = 0
        if len(held.get(lang, [])) > 8:
            held[lang] = [merged(held[lang])]

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        unique, where = np.unique(keys, return_inverse=True)
        return unique, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            g = grams(text.as_py())
            waiting.setdefault(lang, []).append(g)
            sizes[lang] = sizes.get(lang, 0) + len(g)
            if sizes[lang] > CHUNK:
                fold_in(lang)
    for lang in {*held, *waiting}:
        fold_in(lang)
        keys, n = merged(held[lang])
        for a in range(0, len(keys), 100_000):
            part = keys[a : a + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[a : a + 100_000])], ["lang", "gram", "n"])


class Filters:
    """Bit-sliced Bloom filters of the n-grams of up to any number of languages."""

    def __init__(self, langs: list[str], keys: np.ndarray, member: np.ndarray):
        """member[i, k]: language k contains keys[i]."""
        self.langs = langs
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * SPARSITY))))
        self.rows = np.zeros((1 << self.bits, -(-len(langs) // 8) or 1), np.uint8)
        packed = np.packbits(member, axis=1, bitorder="little") if len(langs) else np.zeros((0, 1), np.uint8)
        for at in self._positions(keys):
            np.bitwise_or.at(self.rows, at, packed)
        fill = np.unpackbits(self.rows, axis=1, bitorder="little")[:, : len(langs)].mean(axis=0)
        self.false = fill**HASHES

    def _positions(self, keys: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return [((keys >> np.uint64(k * 32)) & mask).astype(np.int64) if self.bits <= 32 else (keys * np.uint64(2 * k + 1)) >> np.uint64(64 - self.bits) for k in range(HASHES)]

    def languages(self, keys: np.ndarray) -> np.ndarray:
        """A row of bits for each n-gram."""
        a, *more = self._positions(keys)
        found = self.rows[a]
        for at in more:
            found &= self.rows[at]
        return found

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, less the expected false positives."""
        found = self.languages(keys)
        each = [np.bincount(found[:, b], minlength=256) @ _BITS for b in range(found.shape[1])]
        raw = np.concatenate(each)[: len(self.langs)]
        return np.clip((raw - len(keys) * self.false) / np.maximum(1 - self.false, 1e-9), 0, None)

    def predict(self, text: str | None) -> tuple[str, float]:
        keys = grams(text)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        counts = self.counts(keys)
        best = int(np.argmax(counts))
        return self.langs[best], min(1.0, float(counts[best]) / len(keys))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def train(labelled: DataFrame, scratch: Scratch) -> Filters:
    """Filters from all rows of labelled (lang, text). Rows without lang or text teach nothing.

    The languages are ordered by their number of n-grams, then by name; earlier ones win ties.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    counts = scratch.save(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda k: (-totals[k], k))
    if not langs:
        return Filters([], np.empty(0, np.uint64), np.empty((0, 0), bool))
    shares = counts.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))) / F.lit(float(totals[k])), F.lit(0.0)).alias(f"s{i}") for i, k in enumerate(langs)))
    share = [F.col(f"s{i}") for i in range(len(langs))]
    most = F.greatest(*share) if len(share) > 1 else share[0]
    member = [((s >= FLOOR) & (s >= most * RATIO)).alias(f"m{i}") for i, s in enumerate(share)]
    found = shares.where(most >= FLOOR).select("gram", *member).toPandas()  # at most 1 / FLOOR for each language
    return Filters(langs, found["gram"].to_numpy(np.int64).view(np.uint64), found.drop(columns="gram").to_numpy(bool))


def predictor(spark, filters: Filters):
    """A column function: text to struct(lang_pred, score)."""
    sent = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def trained_on(docs: DataFrame, scratch: Scratch) -> Filters:
    return train(docs.where(~held_out(F.col("doc_id"))), scratch)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang, ...).

    The filters learn from the rows with lang that aren't held out. Null text and text without
    letters is 'und' with score 0, and so is all text where nothing could be learned. Ties go to
    the language with most training n-grams. score is the corrected share of the text's n-grams that
    the language contains. A null doc_id isn't held out. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "language-id")
    predict = predictor(docs.sparkSession, trained_on(docs, scratch))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def cuts(docs: DataFrame, predict, least_score: float = LEAST_SCORE) -> tuple[dict[str, float], float]:
    """{language: the least score of its text}, and that of other languages, from held-out docs that are told as labelled."""
    told = docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", predict("text").alias("p"))
    right = told.where("lang = p.lang_pred").select("lang", "p.score")
    # A row for each language, and one for all.
    rows = right.rollup("lang").agg(F.percentile_approx("score", QUANTILE, 10_000).alias("low"), F.count(F.lit(1)).alias("n")).collect()
    found = {r.lang: max(least_score, SLACK * r.low) for r in rows if r.n >= LEAST}
    general = found.pop(None, least_score)
    return found, general


def drop_unidentified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with all columns, whose text is in a known language: its score reaches the language's cut.

    Null texts and texts without letters go; rows that repeat stay or go together. Other columns may have any names and
    values. Where nothing could be learned, and from an empty table, no rows stay.
    """
    scratch = Scratch(docs.sparkSession, "language-id-keep")
    predict = predictor(docs.sparkSession, trained_on(docs, scratch))
    by_lang, general = cuts(docs, predict, least_score)
    (as_told,) = unused(docs, "told")
    told = docs.withColumn(as_told, predict(docs["text"]))
    cut = F.lit(general)
    for lang, least in by_lang.items():
        cut = F.when(F.col(f"{as_told}.lang_pred") == lang, least).otherwise(cut)
    return told.where((F.col(f"{as_told}.lang_pred") != UNKNOWN) & (F.col(f"{as_told}.score") >= cut)).drop(as_told)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
