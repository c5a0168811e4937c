"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, so it knows every script and has no vocabulary to bound: n-grams of up to ORDER bytes, as many as
trusted text has. Counts are summed up by n-gram; below the top, an n-gram counts the bytes it follows. Contexts have the total
of their n-grams' counts, and how many of these are 1, 2 and more.

Neither the model nor the documents are ever whole in one place. Documents are packed in blocks; a block asks
for its distinct n-grams, split by hash into the shards of the model, and each shard answers in the order asked, in whole
counts, of which the block makes probabilities. So an n-gram travels once for each block, not for each place where it stands. Perplexities are held against a quantile,
language by language, of those of trusted documents kept back from training.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from lodestone.session import Scratch, table

from .filters import hash_filter, passing
from .folds import fold
from .rows import unused, with_group
from .units import chunks, raw_bytes
from .workers import release, tidy

ORDER = 5
#: A document counts as having so many more bytes of the mean of its language: short ones say little.
PRIOR = 100
#: Trusted documents of this fold are kept back, to set thresholds.
FOLDS, KEPT_BACK = 5, 0
#: A document is kept up to this quantile of trusted documents' perplexity, times SLACK.
QUANTILE, SLACK = 0.99, 1.15
#: Languages with fewer trusted documents kept back use the threshold of all languages.
LEAST = 20
#: Bytes of a block of documents, or one document; and bytes that are worked on at a time.
BLOCK, CHUNK = 12_000_000, 1_000_000
#: n-grams of a shard of the model, about.
SHARD = 100_000
#: Keys hold an n-gram's bytes below its order.
_TAG = np.uint64(56)


# --- n-grams -------------------------------------------------------------------------------


def _low(grams: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes."""
    return grams & np.uint64((1 << (8 * k)) - 1)


def _tagged(grams: np.ndarray, k: int) -> np.ndarray:
    return grams | (np.uint64(k) << _TAG)


def grams(data: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte of the texts data[at[i]:at[i + 1]], each of which follows order - 1 zero bytes."""
    pad = order - 1
    real = np.ones(len(data) + pad * (len(at) - 1), bool)
    real[(at[:-1] + pad * np.arange(len(at) - 1))[:, None] + np.arange(pad)] = False
    padded = np.zeros(len(real), np.uint64)
    padded[real] = data
    key = padded.copy()
    for j in range(1, order):
        key[j:] |= padded[: len(padded) - j] << np.uint64(8 * j)
    return key[real]


def _pieces(data: np.ndarray, at: np.ndarray, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, codes, distinct): the n-grams of some texts by their code among distinct ones."""
    for a, b in chunks(np.diff(at).tolist(), CHUNK):
        key = grams(data[at[a] : at[b]], at[a : b + 1] - at[a], order)
        found = pa.array(key).dictionary_encode()
        yield a, b, found.indices.to_numpy(), found.dictionary.to_numpy()


def _counter(order: int):
    """(pressed) to (gram, n), the counts of a part of the table."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = pa.array([unpress.decompress(x.as_buffer()) if x.as_buffer().size else b"" for x in batch.column("pressed")], pa.large_binary())
            for _, _, codes, distinct in _pieces(*raw_bytes(texts), order):
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))], ["gram", "n"])

    return run


def _block_press() -> zstandard.ZstdCompressor:
    """Finds copies within a whole block."""
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(9, window_log=24, enable_ldm=True))


@tidy
def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed form, so that less travels."""
    press = zstandard.ZstdCompressor(level=5)
    for batch in batches:
        pressed = [press.compress(x.as_buffer()) if x.is_valid and x.as_buffer().size else b"" for x in batch.column("text")]
        yield batch.drop_columns(["text"]).append_column("pressed", pa.array(pressed, pa.binary()))


def discounts(of: dict[int, int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (of.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    clip = lambda d, k: min(max(d, 0.05), k - 0.05)
    return clip(1 - 2 * y * n2 / n1, 1), clip(2 - 3 * y * n3 / n2, 2), clip(3 - 4 * y * n4 / max(n3, 1), 3)


#: What the model knows of a key: the n-gram's own count; of the n-grams that it is the context of, their counts' total
#: and how many have counts 1, 2 and more. None of it is 0 for want of being counted.
FACTS = ("n", "total", "ones", "twos", "more")


class Model(NamedTuple):
    """rows are (key, n, total, ones, twos, more); a key may be in two rows, one with n and one with the others. Keys are
    n-grams below their order. discounts[k] are those of order k."""

    rows: DataFrame
    discounts: np.ndarray


def train(trusted: DataFrame, scratch: Scratch, order: int = ORDER) -> Model:
    """The model of all rows of trusted (pressed)."""
    counts = trusted.select("pressed").mapInArrow(_counter(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    orders = {order: scratch.save(counts, "counts")}
    for k in range(order - 1, 0, -1):  # below the top, an n-gram counts the bytes it follows
        low = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")
        orders[k] = scratch.save(orders[k + 1].select(low).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), f"order{k}")
    rows, off = None, np.zeros((order + 2, 3))
    for k, held in orders.items():
        off[k] = discounts({r.n: r.c for r in held.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()})
        key = lambda c, of: F.col(c).bitwiseOR(F.lit(of << int(_TAG))).alias("key")
        facts = [F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.count_if(F.col("n") > 2).alias("more")]
        contexts = held.groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(*facts).select(key("context", k - 1), *FACTS[1:])
        both = held.select(key("gram", k), "n").unionByName(contexts, allowMissingColumns=True)
        rows = both if rows is None else rows.unionByName(both)
    rows = scratch.save(rows.select("key", *FACTS), "model")
    scratch.drop(*orders.values())
    return Model(rows, off)


# --- blocks, what they ask, and what shards answer -------------------------------------------


def _packed(size: int):
    """(doc_id, text_key, lang, text) to a row for each block: arrays of these, sizes, and all bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            all_ = pa.Table.from_batches(held).combine_chunks()
            texts = all_.column("text").combine_chunks()
            data, at = raw_bytes(texts)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [one(all_.column(c).combine_chunks()) for c in ("doc_id", "text_key", "lang")]
            packed = _block_press().compress(np.ascontiguousarray(data))
            return pa.RecordBatch.from_arrays([*cols, one(pa.array(np.diff(at))), pa.array([packed], pa.binary())], ["doc_id", "text_key", "lang", "size", "data"])

        for batch in batches:
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").fill_null(""))
            for a, b in chunks(pc.binary_length(batch.column("text")).to_pylist(), CHUNK):
                part = batch.slice(a, b - a)
                more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and n + more > size:
                    yield out()
                    held, n = [], 0
                held.append(part)
                n += more
        if held:
            yield out()

    return run


def _opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(batch.column("size")[row].values.to_numpy())]).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(batch.column("data")[row].as_buffer(), max_output_size=max(1, int(at[-1])))
    return np.frombuffer(data, np.uint8), at


def _wanted(distinct: np.ndarray, shards: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What to ask for to score some distinct n-grams: sorted keys; their order by shard; where each shard's begin in it."""
    parts = []
    for k in range(1, order + 1):
        own = np.unique(_low(distinct, k))
        parts += [_tagged(own, k), _tagged(np.unique(own >> np.uint64(8)), k - 1)]
    keys = np.unique(np.concatenate(parts))
    shard = _shard(keys, shards)
    by = np.argsort(shard, kind="stable")
    return keys, by, np.searchsorted(shard[by], np.arange(shards + 1))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _distinct(pieces: list) -> np.ndarray:
    return np.unique(np.concatenate([d for *_, d in pieces])) if pieces else np.empty(0, np.uint64)


def _asking(shards: int, order: int):
    """(block, size, data) to (shard, block, payload): the keys of a block in a shard, sorted."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in range(batch.num_rows):
                keys, by, edge = _wanted(_distinct([(some,) for *_, some in _pieces(*_opened(batch, row), order)]), shards, order)
                asked = [(s, press.compress(np.diff(keys[by[edge[s] : edge[s + 1]]], prepend=np.uint64(0)).tobytes())) for s in range(shards) if edge[s + 1] > edge[s]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in asked], pa.int32()), pa.array([batch.column("block")[row].as_py()] * len(asked), pa.int64()), pa.array([p for _, p in asked], pa.binary())],
                    ["shard", "block", "payload"],
                )
                del keys, by, asked
                release()

    return run


def _sharded(shards: int):
    """Rows of a model with the shard of each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard(batch.column("key").to_numpy().view(np.uint64), shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", *batch.schema.names])

    return run


def _planes(counts: np.ndarray) -> bytes:
    """The counts' bytes, equal ones of all of them together, as they compress well."""
    return counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if len(values):
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        yield from zip(edges, edges[1:])


@tidy
def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards, each one's model before what it is asked, to (block, shard, payload): FACTS in the order asked, 0 where the model has none."""
    press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    shard, held, ready = None, [], None
    for batch in batches:
        blocks, numbers, out = [], [], []
        shards, asks = batch.column("shard").to_numpy(), batch.column("block").is_valid().to_numpy(zero_copy_only=False)
        for a, b in _runs(shards * 2 + asks):
            if shards[a] != shard:
                shard, held, ready = int(shards[a]), [], None
            if not asks[a]:
                held.append([batch.column(c).slice(a, b - a).fill_null(0).to_numpy() for c in ("key", *FACTS)])
                continue
            if ready is None:
                key, n, *of_context = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.empty(0, np.int64)] * (1 + len(FACTS))
                held, ready = [], []
                for there, facts in ((n > 0, [n]), (n == 0, of_context)):
                    k = key[there].view(np.uint64)
                    order = np.argsort(k)
                    ready.append((k[order], [v[there][order] for v in facts]))
                del key, n, of_context
            for row in range(a, b):
                asked = np.cumsum(np.frombuffer(unpress.decompress(batch.column("payload")[row].as_buffer()), np.uint64))
                got = []
                for keys, facts in ready:
                    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                    hit = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
                    for values in facts:
                        answer = np.zeros(len(asked), np.int64)
                        answer[hit] = values[at[hit]]
                        got.append(press.compress(_planes(answer)))
                blocks.append(batch.column("block")[row].as_py())
                numbers.append(shard)
                out.append(got)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(numbers, pa.int32()), pa.array(out, pa.list_(pa.binary()))], ["block", "shard", "payload"])


def _log_probabilities(distinct: np.ndarray, keys: np.ndarray, own: np.ndarray, total: np.ndarray, back: np.ndarray, order: int) -> np.ndarray:
    """Of each n-gram's last byte after the others: p(w | context) = (own + back(context) * p(w | shorter context)) / total(context).

    own are counts less their discounts, back what the discounts of a context's n-grams come to. Without counts, the context says nothing.
    """
    p = np.full(len(distinct), 1 / 256)
    for k in range(1, order + 1):
        low = _low(distinct, k)
        at = np.searchsorted(keys, _tagged(low >> np.uint64(8), k - 1))
        mine = own[np.searchsorted(keys, _tagged(low, k))] + back[at] * p
        np.divide(mine, total[at], out=p, where=total[at] > 0)
    return np.log(np.maximum(p, 1e-30))


def _discounted(keys: np.ndarray, facts: list[np.ndarray], off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, total, back) of some keys, by their facts and the discounts of each order."""
    n, total, *kinds = facts
    k = (keys >> _TAG).astype(np.int64)
    own = np.where(n > 0, n - off[k, np.clip(n, 1, 3) - 1], 0)
    return own, total, sum(off[k + 1, i] * some for i, some in enumerate(kinds))


def _scorer(shards: int, order: int, off: np.ndarray):
    """Rows of blocks, each one's answers by shard before the block, to (doc_id, text_key, lang, n_symbols, loss)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        block, answers = None, []
        for batch in batches:
            numbers, answer = batch.column("block").to_pylist(), batch.column("payload").is_valid().to_pylist()
            for row in range(batch.num_rows):
                if numbers[row] != block:
                    block, answers = numbers[row], []
                if answer[row]:
                    answers.append(batch.column("payload")[row].as_py())
                    continue
                data, at = _opened(batch, row)
                pieces = [*_pieces(data, at, order)]
                distinct = _distinct(pieces)
                loss = np.zeros(len(at) - 1)
                if len(distinct):
                    keys, by, edge = _wanted(distinct, shards, order)
                    values = np.empty((3, len(keys)))
                    for shard, payload in zip(np.flatnonzero(np.diff(edge)).tolist(), answers, strict=True):
                        some = by[edge[shard] : edge[shard + 1]]
                        values[:, some] = _discounted(keys[some], [_counts(unpress.decompress(x)) for x in payload], off)
                    # A block's arrays are large; those that have done their work go before more are made.
                    answers = []
                    del by, some, payload
                    logs = _log_probabilities(distinct, keys, *values, order)
                    del keys, values
                    for a, b, codes, some in pieces:
                        total = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(distinct, some)][codes])])
                        loss[a:b] = -np.diff(total[at[a : b + 1] - at[a]])
                cols = [batch.column(c)[row].values for c in ("doc_id", "text_key", "lang", "size")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(loss)], ["doc_id", "text_key", "lang", "n_symbols", "loss"])
                answers = []
                del data, pieces, distinct
                release()

    return run


def losses(docs: DataFrame, model: Model, scratch: Scratch, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, lang, n_symbols, loss) for every row of docs (doc_id, text_key, lang, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = docs.select("doc_id", "text_key", "lang", "text").mapInArrow(_packed(block), f"doc_id array<{kind}>, text_key array<long>, lang array<string>, size array<long>, data binary")
    packed = scratch.save(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    shards = max(16, ceil(model.rows.count() / SHARD))
    asked = packed.select("block", "size", "data").mapInArrow(_asking(shards, order), "shard int, block long, payload binary")
    known = model.rows.mapInArrow(_sharded(shards), "shard int, key long, n long, total long, ones long, twos long, more long")
    both = known.select("shard", "key", *FACTS, F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("payload")).unionByName(asked, allowMissingColumns=True)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = both.repartition(max(least, shards), "shard").sortWithinPartitions("shard", F.asc_nulls_first("block")).mapInArrow(_answers, "block long, shard int, payload array<binary>")
    met = packed.select("block", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("array<binary>").alias("payload"), "doc_id", "text_key", "lang", "size", "data").unionByName(answers, allowMissingColumns=True)
    met = met.repartition(max(least, packed.count() // 8), "block").sortWithinPartitions("block", F.asc_nulls_last("shard"))
    found = scratch.save(met.mapInArrow(_scorer(shards, order, model.discounts), f"doc_id {kind}, text_key long, lang string, n_symbols long, loss double"), "scores")
    scratch.drop(packed, model.rows)
    scratch.settle()
    return found


# --- verdicts ------------------------------------------------------------------------------


def _trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that labels (doc_id, quality) always call good."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")


def _training(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, pressed) of the trusted docs that are not kept back; a filter of bounded size keeps back most others before any text moves."""
    key = F.xxhash64(F.col("doc_id").cast("string")).alias("id_key")
    sent = docs.sparkSession.sparkContext.broadcast(hash_filter(trusted.select(key), "id_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.select("doc_id", key, "text").where((fold(F.col("doc_id"), FOLDS) != KEPT_BACK) & F.col("text").isNotNull())
    keep = passing(sent)
    some = some.mapInArrow(lambda batches: _press(keep(batches)), f"doc_id {kind}, id_key long, pressed binary")
    return some.drop("id_key").join(trusted.hint("merge"), "doc_id", "left_semi")


def scored(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, lang, n_symbols, perplexity, threshold, kept) for every row of docs."""
    trusted = scratch.save(_trusted_ids(labels), "trusted")  # these grow with the corpus: joined in one way at every size
    model = train(_training(docs, trusted), scratch)
    scratch.settle()
    found = losses(docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text"), model, scratch)

    back = found.where(fold(F.col("doc_id"), FOLDS) == KEPT_BACK).join(trusted.hint("merge"), "doc_id", "left_semi").where("n_symbols > 0")
    back = scratch.save(back.select("lang", "n_symbols", "loss"), "back")
    mean = (F.sum("loss") / F.sum("n_symbols")).alias("mean")
    means = scratch.save(back.groupBy("lang").agg(mean), "means")
    of_all = back.agg(mean).first().mean
    of_all = found.agg(mean).first().mean if of_all is None else of_all
    of_all = 0.0 if of_all is None else of_all
    perplexity = F.exp((F.col("loss") + PRIOR * F.col("mean")) / (F.col("n_symbols") + PRIOR))

    told = back.join(means, "lang").withColumn("perplexity", perplexity)
    cut = (F.percentile_approx("perplexity", QUANTILE, 10_000) * SLACK).alias("threshold")
    by_lang = told.groupBy("lang").agg(cut, F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("lang", "threshold")
    general = told.agg(cut).first().threshold
    general = float("inf") if general is None else general
    # One language may be most of the corpus: its rows meet what is known of it in parts.
    langs = found.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).join(means, "lang").join(by_lang, "lang", "left")
    out = with_group(found, scratch.save(langs, "langs"), ["lang"], "doc_id")
    out = out.withColumn("mean", F.coalesce("g.mean", F.lit(of_all))).withColumn("threshold", F.coalesce("g.threshold", F.lit(general))).withColumn("perplexity", perplexity)
    kept = (F.col("n_symbols") > 0) & (F.col("perplexity") <= F.col("threshold"))
    return out.select("doc_id", "text_key", "lang", "n_symbols", "perplexity", "threshold", kept.alias("kept"))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, kept) for every row of docs (doc_id, text, lang, ...).

    labels (doc_id, quality) tells what text is trusted: ids whose every label is 1. Symbols are bytes. Null lang is a
    language of its own, ''. Null and empty text has no symbols, the mean perplexity of its
    language, and isn't kept. Without trusted text the model is uniform and all other text is kept.
    Rows that repeat are rated alike. An empty table gives no rows. Other columns are not read.
    """
    return scored(docs, labels, Scratch(docs.sparkSession, "quality")).drop("text_key")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that are kept: as rate() tells. Rows that repeat stay or go together; so null and empty
    texts go, whatever their other columns say. Other columns may have any names and values. An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "quality-keep")
    id_, text, lang = unused(docs, "id", "text", "lang")
    bad = scored(docs, labels, scratch).where("not kept").select(F.col("doc_id").alias(id_), F.col("text_key").alias(text), F.col("lang").alias(lang)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(text)) & (F.coalesce(docs["lang"].cast("string"), F.lit("")) == F.col(lang))
    return docs.join(scratch.save(bad, "dropped").hint("merge"), same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
