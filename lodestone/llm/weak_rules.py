"""Quality by rules that vote or abstain, weighed by how often each is right, which is learned without labels.

Each rule says good, bad or nothing of a document. What documents there are of each pattern of votes is all that expectation
maximisation needs, and there are at most 3 ** rules patterns whatever the corpus, so one pass over the texts and one
count serve all rounds, and the fit sees every document. A document's quality is the posterior of its pattern.

A rule is right of good documents with one chance and of bad ones with another, given that it votes; a rule that is no
better than a coin in a round weighs nothing in it. The first guess is the all-must-pass filter: one bad vote is enough. Begun
with the majority of votes, the fit puts faults that only two of the rules see down to errors of these rules. Each chance has an
expectation that counts as much as PRIOR of all documents, at every size, so that a corpus without bad documents isn't split in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.session import Scratch

from .workers import small_batches, tidy

LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
#: Words of these and of characters beyond ASCII are plain.
PLAIN = UPPER + LOWER + DIGITS + b".,;:?!'\"()-" + bytes(range(128, 256))
_CONTINUED = bytes(range(128, 192))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: In percent: up to the first a rule says good, above the second bad, and between them nothing.
RULES = {
    "symbols": ("n_symbols", "n_words", 2, 10),
    "repeats": ("n_repeat_words", "n_words", 10, 30),
    "stutter": ("n_stutter", "n_words", 5, 20),
    "lines": ("n_dup_lines", "n_lines", 10, 30),
    "capitals": ("n_upper", "n_letters", 10, 30),
    "odd_words": ("n_odd", "n_words", 10, 30),
    "exclamations": ("n_exclaimed", "n_words", 10, 30),
    "long_words": ("word_chars", "n_latin_words", 1000, 1500),
    "same_words": ("n_again", "n_words", 50, 75),
}
GOOD, BAD = 1, 2
#: What a rule's chance is expected to be, of good and of bad documents (a rule sees one fault of several), and what that weighs against the documents.
EXPECTED_GOOD, EXPECTED_BAD, PRIOR = 0.95, 0.3, 0.03
#: The first guess of documents without a bad vote and with one.
FIRST = 0.95, 0.05
ROUNDS, CLOSE = 500, 1e-10


def repeated(ids: np.ndarray, distinct: int, size: int = 3) -> int:
    """How many positions lie in a window of so many ids that occurs twice or more."""
    if len(ids) <= size or distinct == len(ids):
        return 0
    key = ids[: len(ids) - size + 1]
    for j in range(1, size):
        if j > 1:  # else a product of large ids may overflow
            key = np.unique(key, return_inverse=True)[1]
        key = key * distinct + ids[j : len(ids) - size + 1 + j]
    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
    again = n[which] > 1
    covered = np.zeros(len(ids), bool)
    for j in range(size):
        covered[j : len(again) + j] |= again
    return int(np.count_nonzero(covered))


def measures(text: bytes) -> dict[str, int]:
    """What rules look at. Words are cut at spaces and \\x09 to \\x0D; a latin word counts where A-Z and a-z are half of all in words."""
    words = text.split()
    codes = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, SPACES + _CONTINUED))
    upper = len(text) - len(text.translate(None, UPPER))
    letters = len(text) - len(text.translate(None, UPPER + LOWER))
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated(ids, len(codes)),
        "n_stutter": int(np.count_nonzero(ids[1:] == ids[:-1])),
        "n_lines": len(lines) if len(lines) > 1 else 0,
        "n_upper": upper,
        "n_letters": letters,
        "n_odd": len(text.translate(None, PLAIN).split()),
        "n_exclaimed": text.count(b"!"),
        "n_latin_words": len(words) if 2 * letters >= chars else 0,
        "n_again": len(words) - len(codes),
    }


def votes(of: dict[str, int]) -> list[int]:
    """GOOD, BAD or 0 from each rule; a rule has nothing to say of a text without what it takes shares of."""
    return [0 if not of[whole] else GOOD if 100 * of[part] <= low * of[whole] else BAD if 100 * of[part] > high * of[whole] else 0 for part, whole, low, high in RULES.values()]


def pattern(said: list[int]) -> int:
    return sum(v * 3**j for j, v in enumerate(said))


@tidy
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[int]] = [[] for _ in range(len(COUNTS) + 1)]
        for text in batch.column("text").fill_null("").cast(pa.large_binary()):
            of = measures(text.as_py())
            for column, x in zip(out, [*(of[c] for c in COUNTS), pattern(votes(of))]):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", *COUNTS, "pattern"])


def posteriors(patterns: np.ndarray, weights: np.ndarray, rules: int = len(RULES), held: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """The chance that a document of each pattern is good, and (chance to be right of good ones, of bad ones) of each rule.

    Patterns come in ascending order, so that sums are always the same.
    """
    said = patterns[:, None] // 3 ** np.arange(rules) % 3
    good, bad = (said == GOOD).astype(float), (said == BAD).astype(float)
    chance = np.where(bad.any(1), FIRST[1], FIRST[0])
    total = weights.sum()
    prior = held * total
    rates = np.zeros((rules, 2))
    for _ in range(ROUNDS):
        of_good, of_bad = weights * chance, weights * (1 - chance)
        share = (of_good.sum() + prior * 0.5) / (total + prior)
        right_good = (of_good @ good + prior * EXPECTED_GOOD) / (of_good @ (good + bad) + prior)
        right_bad = (of_bad @ bad + prior * EXPECTED_BAD) / (of_bad @ (good + bad) + prior)
        tells = right_good + right_bad > 1
        for_good = np.where(tells, np.log(right_good) - np.log1p(-right_bad), 0.0)
        for_bad = np.where(tells, np.log1p(-right_good) - np.log(right_bad), 0.0)
        odds = np.log(share) - np.log1p(-share) + good @ for_good + bad @ for_bad
        new = 1 / (1 + np.exp(-odds))
        moved = np.abs(new - chance).max()
        chance, rates = new, np.column_stack([right_good, right_bad])
        if moved < CLOSE:
            break
    return chance, rates


def label_model(measured: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(pattern, quality) for each pattern of measured, and the chances of each rule to be right of good and of bad documents."""
    spark = measured.sparkSession
    found = measured.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()  # at most 3 ** rules rows
    chance, rates = posteriors(found["pattern"].to_numpy(np.int64), found["n"].to_numpy(float)) if len(found) else (np.zeros(0), np.zeros((len(RULES), 2)))
    rows = list(zip(found["pattern"].tolist(), chance.tolist()))
    return spark.createDataFrame(rows, "pattern long, quality double"), {name: (a, b) for name, (a, b) in zip(RULES, rates.tolist())}


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality, good_votes, bad_votes) of every row of docs.

    docs has doc_id and text; other columns are not read. Null text is empty and fails. Each row is judged by its own
    text, whatever its doc_id, so rows that repeat or have none are judged like others; equal texts have equal verdicts.
    An empty table gives no rows. kept: the base rules hold, and quality is at least a half.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    with small_batches(spark):
        measured = Scratch(spark, "weak-rules").save(given.mapInArrow(_measured, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, pattern long"), "measured")
    model, _ = label_model(measured)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    digits = [F.floor(F.col("pattern") / 3**j) % 3 for j in range(len(RULES))]
    told = measured.join(F.broadcast(model), "pattern").withColumn("base_failed", base)
    return told.select(
        "doc_id",
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"),
        "quality",
        *(sum((F.when(d == vote, 1).otherwise(0) for d in digits), F.lit(0)).alias(name) for vote, name in ((GOOD, "good_votes"), (BAD, "bad_votes"))),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from lodestone.session import table

    return judge(table(spark, sf_dir, "documents"))
