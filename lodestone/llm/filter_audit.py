"""What each filter of a chain removes in each order of the chain, and which label-1 documents go with it.

A document is judged once by every filter; what it fails is a mask of bits. A table of masks by orders holds the step
at which an order removes a mask, so a batch of documents is looked up for all orders at once, and what each
order removes at each step is a count of table entries. Tasks keep one array of counts for each part, and
the arrays are summed. A text's copies are known by its SHA-256: the smallest doc_id of each is found with partial
minima, and rows are told whether they are it by a join on digest and id, so that copies are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.session import Scratch

from .workers import small_batches, tidy

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: A task gives its arrays away when it has those of so many parts.
PARTS = 256
_SEEN = {"removed": None, "good": "good", "toxic": "toxic"}


def failed(text: bytes, points: int) -> int:
    """The bits of the filters that look at the text alone; bit i is of the i-th letter. points: its code points."""
    words = text.split()  # of bytes: at space and \x09 to \x0D
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, UPPER))) > 5 * points) << 2
        | (len(text) != len(text.translate(None, SYMBOLS))) << 3
    )


@tidy
def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").fill_null("")
        points = pc.utf8_length(texts).to_pylist()
        masks, digests = [], []
        for text, n in zip(texts.cast(pa.large_binary()), points):
            raw = text.as_py()
            masks.append(failed(raw, n))
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def orders(letters: str = LETTERS) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def first_failures(letters: str = LETTERS) -> np.ndarray:
    """[mask, order]: the step, from 0, at which the order removes a document that fails the mask's filters; len(letters) if it stays."""
    n = len(letters)
    out = np.full((1 << n, len(orders(letters))), n, np.int64)
    for j, order in enumerate(orders(letters)):
        for step in reversed(range(n)):
            bit = 1 << letters.index(order[step])
            out[[m for m in range(1 << n) if m & bit], j] = step
    return out


def _columns(n: int) -> list[str]:
    return [*(f"{what}{s}" for what in _SEEN for s in range(n)), "documents", *(f"{what}{i}" for what in ("fails", "unique") for i in range(n))]


def _counted(letters: str):
    """Rows (part, mask, good, toxic) as partial counts: a row for each part and order."""
    n, table = len(letters), first_failures(letters)
    named = orders(letters)
    at_order = np.arange(len(named)) * (n + 1)
    # How often each mask fails each filter, and fails nothing else.
    fails = np.array([[m >> i & 1 for i in range(n)] for m in range(1 << n)])
    unique = np.array([[m == 1 << i for i in range(n)] for m in range(1 << n)])

    def rows(held: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        whole = np.concatenate([np.concatenate([removed[:, :, :n].transpose(1, 0, 2).reshape(len(named), -1), np.tile(masks @ np.column_stack([np.ones(1 << n, int), fails, unique]), (len(named), 1))], axis=1) for removed, masks in held.values()])
        keys = [pa.array([p for p in held for _ in named], pa.string()), pa.array(named * len(held), pa.string())]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, np.ascontiguousarray(whole.T))], ["part", "filter_order", *_columns(n)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            masks = batch.column("mask").to_numpy()
            coded = batch.column("part").dictionary_encode()
            codes, parts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            flags = {what: batch.column(what).to_numpy(zero_copy_only=False) for what in ("good", "toxic")}
            for code, part in enumerate(parts):
                mine = codes == code
                mask = masks[mine]
                steps = table[mask] + at_order
                got = held.setdefault(part, [np.zeros((len(_SEEN), len(named), n + 1), np.int64), np.zeros(1 << n, np.int64)])
                for k, flag in enumerate(_SEEN.values()):
                    some = steps if flag is None else steps[flags[flag][mine]]
                    got[0][k] += np.bincount(some.ravel(), minlength=len(named) * (n + 1)).reshape(len(named), n + 1)
                got[1] += np.bincount(mask, minlength=1 << n)
                if len(held) >= PARTS:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return run


def with_copies(judged: DataFrame) -> DataFrame:
    """judged (doc_id, part, mask, digest) with the bit of copies in the masks of rows whose digest a smaller doc_id has too."""
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    # Of a digest only rows of its first id meet here: copies are dealt out by their own ids.
    told = judged.join(firsts.hint("merge"), ["digest", "doc_id"], "left")
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return told.withColumn("mask", F.when(copy, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask"))).select("doc_id", "part", "mask")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of docs (doc_id, text, source, ...). Texts are read once."""
    given = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        judged = Scratch(docs.sparkSession, "filter-audit").save(given.mapInArrow(_judged, f"doc_id {kind}, part string, mask int, digest binary"), "judged")
    return with_copies(judged)


def lost(masks: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, counts) for every part and order, from masks (doc_id, part, mask) and labels (doc_id, quality, toxic, ...).

    A document is good or toxic if one of its labels says 1; a null doc_id has no labels.
    """
    known = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = masks.join(known.hint("merge"), "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    names = _columns(len(letters))
    partial = rows.mapInArrow(_counted(letters), "part string, filter_order string, " + ", ".join(f"{c} long" for c in names))
    return partial.groupBy("part", "filter_order").agg(*(F.sum(c).alias(c) for c in names))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order and step.

    docs has doc_id, text and source, labels doc_id, quality and toxic; other columns are not read. Null text is
    empty, and so is a null source, whose part is the one of empty sources. Of equal texts all rows fail E but those of the
    smallest doc_id; a null doc_id is neither a copy nor makes others copies. Rows that repeat count as often as they occur;
    a label row that repeats counts once. Without documents there are no parts and no rows.
    """
    n = len(LETTERS)
    counts = lost(judge(docs), labels)
    letter = [F.substring("filter_order", s + 1, 1) for s in range(n)]

    def of_filter(what: str, s: int):
        return sum((F.when(letter[s] == x, F.col(f"{what}{i}")).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))

    steps = []
    for s in range(n):
        kept = F.col("documents") - sum((F.col(f"removed{t}") for t in range(s + 1)), F.lit(0))
        steps.append(
            F.struct(
                F.lit(s + 1).alias("step"),
                letter[s].alias("letter"),
                kept.alias("kept"),
                F.col(f"removed{s}").alias("removed"),
                (of_filter("fails", s) - F.col(f"removed{s}")).alias("redundant"),
                of_filter("unique", s).alias("unique_fails"),
                F.col(f"good{s}").alias("good_lost"),
                F.col(f"toxic{s}").alias("toxic_lost"),
            )
        )
    rows = counts.select("part", "filter_order", F.inline(F.array(*steps)))
    # A part's filter has a row for each order.
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def query(spark, sf_dir: str) -> DataFrame:
    from lodestone.session import table

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t))::INT
    + 8 * regexp_matches(w.t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS mask
    FROM w JOIN firsts ON w.t = firsts.t LEFT JOIN known ON w.doc_id = known.doc_id),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | coalesce(before, 0)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost
    FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM x
"""
