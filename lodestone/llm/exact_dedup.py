"""Exact deduplication by deterministic block naming.

A text's UTF-8 bytes, with A-Z lower-cased, are cut into blocks of a fixed size. Equal blocks
get one integer name: the distinct blocks are dealt out by hash, sorted, and numbered. Names of
adjacent blocks are then paired, and equal pairs named in the same way, until each document
has one name. Two documents of as many blocks have the same name only if all bytes are equal.

A document with a block whose 64-bit hash no other block has is like no other: that hash is its name. Only the
blocks of the others travel, once from each task. Blocks whose hash stands for two blocks or more are named by their
bytes, so no hash collision can join two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestone.session import Scratch

from .filters import hash_filter, passes
from .rows import keep_rows, with_group
from .units import raw_bytes
from .workers import tidy

BLOCK_BYTES = 16_384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the missing right half of a last odd block; no name has this value.
NO_NAME = -(2**63)
#: Bytes of blocks that a task remembers as sent.
REMEMBERED = 32_000_000
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _texts(batch: pa.RecordBatch) -> tuple[memoryview, list[int]]:
    """The lower-cased bytes of all texts, and where each begins and the last one ends."""
    data, at = raw_bytes(batch.column("text").fill_null(""))
    return memoryview(_LOWER[data]), at.tolist()


def _starts(a: int, b: int, size: int) -> range:
    return range(a, max(b, a + 1), size)


def _describe(size: int, block_hash):
    """(doc_id, text_key, text) to (doc_id, text_key, sha, hashes): a hash for each block; an empty text has one, empty."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _texts(batch)
            sha, hashes, ends = [], [], [0]
            for a, b in zip(at, at[1:]):
                sha.append(hashlib.sha256(data[a:b]).digest())
                hashes += [block_hash(data[x : min(x + size, b)]) for x in _starts(a, b, size)]
                ends.append(len(hashes))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sha, pa.binary()), lists], ["doc_id", "text_key", "sha", "hashes"])

    return run


def _blocks(size: int, block_hash, sent, whole: bool):
    """(doc_id, text) to blocks whose hash is in the filter.

    If whole, (h, block) of documents of which all blocks are, each block about once; else (doc_id, sha, pos, h, block).
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, held = sent.value, set(), 0
        for batch in batches:
            data, at = _texts(batch)
            ids = batch.column("doc_id")
            spans = [[(x, min(x + size, b)) for x in _starts(a, b, size)] for a, b in zip(at, at[1:])]
            h = np.array([block_hash(data[x:y]) for own in spans for x, y in own], np.uint64)
            hit, k = passes(bits, h).tolist(), 0
            signed = h.view(np.int64).tolist()
            doc, sha, pos, hs, blocks, total = [], [], [], [], [], 0

            def out():
                cols = [pa.array(hs, pa.int64()), pa.array(blocks, pa.binary())]
                if whole:
                    return pa.RecordBatch.from_arrays(cols, ["h", "block"])
                return pa.RecordBatch.from_arrays([ids.take(pa.array(doc, pa.int64())), pa.array(sha, pa.binary()), pa.array(pos, pa.int32()), *cols], ["doc_id", "sha", "pos", "h", "block"])

            for i, own in enumerate(spans):
                mine = range(k, k + len(own))
                k += len(own)
                if whole and not all(hit[j] for j in mine):
                    continue
                digest = None if whole else hashlib.sha256(data[at[i] : at[i + 1]]).digest()
                for p, (j, (x, y)) in enumerate(zip(mine, own)):
                    if not hit[j]:
                        continue
                    block = bytes(data[x:y])
                    if whole:
                        if block in seen:
                            continue
                        held += len(block) + 64
                        if held > REMEMBERED:
                            seen, held = set(), 0
                        seen.add(block)
                    doc.append(i)
                    sha.append(digest)
                    pos.append(p)
                    hs.append(signed[j])
                    blocks.append(block)
                    total += len(block)
                if total > 4_000_000:
                    yield out()
                    doc, sha, pos, hs, blocks, total = [], [], [], [], [], 0
            yield out()

    return run


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_texts(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, block_hash=xxhash.xxh3_64_intdigest) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, rid, sha) for each row of docs (doc_id, text), and (rid, n, name) for those that may be like another.

    rid tells rows apart, so rows with the same doc_id are rows of their own. (n, name) is equal
    for two rows exactly if their texts are equal after lower-casing A-Z; null counts as empty. Rows
    without a name are like no other. text_key is xxhash64 of the text as it is.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_describe(block_bytes, block_hash), f"doc_id {kind}, text_key long, sha binary, hashes array<long>")
    refs = scratch.save(told.withColumn("rid", F.monotonically_increasing_id()), "refs")
    heads = refs.select("doc_id", "text_key", "rid", "sha")
    each = refs.select("rid", F.explode("hashes").alias("h"))
    counts = scratch.save(each.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("rid").alias("rid")), "hashes")
    alone = counts.where("size = 1").select("rid").distinct()
    some = scratch.save(refs.join(alone, "rid", "left_anti").select("doc_id", "sha", "rid", "hashes"), "some")
    shared = counts.where("size > 1")
    if some.isEmpty():
        return heads, spark.createDataFrame([], "rid long, n int, name long")
    text = docs.select("doc_id", "text")
    sent = spark.sparkContext.broadcast(hash_filter(shared, "h"))
    named = _numbered(text.mapInArrow(_blocks(block_bytes, block_hash, sent, True), "h long, block binary").distinct(), "block")
    by_hash = scratch.save(named.groupBy("h").agg(F.count(F.lit(1)).alias("blocks"), F.min("name").alias("name")), "names")
    parts = some.select("doc_id", "sha", "rid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    met = scratch.save(with_group(parts, by_hash.join(counts.select("h", "size"), "h"), ["h"], "rid"), "met")
    level = met.where("g.blocks = 1").select("rid", "n", "pos", F.col("g.name").alias("name"))
    more = met.where("g.blocks > 1")
    if not more.isEmpty():
        sent = spark.sparkContext.broadcast(hash_filter(more, "h"))
        blocks = text.mapInArrow(_blocks(block_bytes, block_hash, sent, False), f"doc_id {kind}, sha binary, pos int, h long, block binary")
        blocks = scratch.save(blocks.distinct(), "blocks")
        names = scratch.save(_numbered(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size")), "block").withColumn("name", -1 - F.col("name")), "bytes")
        own = with_group(blocks, names, ["block"], "sha").select(F.col("doc_id").alias("_id"), "sha", "pos", F.col("g.name").alias("name"))
        wanted = more.select("doc_id", "sha", "rid", "n", "pos")
        same = wanted["doc_id"].eqNullSafe(own["_id"]) & (wanted["sha"] == own["sha"]) & (wanted["pos"] == own["pos"])
        level = level.unionByName(wanted.join(own, same).select("rid", "n", wanted["pos"], "name"))
    level = scratch.save(level, "level")
    longest = level.agg(F.max("n")).first()[0] or 1
    done = [level.where("n = 1").select("rid", "n", "name")]
    left = 1
    while left < longest:
        pairs = (
            level.where(f"n > {left}")
            .groupBy("rid", "n", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
            .withColumn("b", F.coalesce("b", F.lit(NO_NAME)))
        )
        pairs = scratch.save(pairs, "pairs")
        names = scratch.save(_numbered(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("size")), "a", "b"), "names")
        level = scratch.save(with_group(pairs, names, ["a", "b"], "rid").select("rid", "n", "pos", F.col("g.name").alias("name")), "level")
        done.append(level.where(f"n > {left} and n <= {2 * left}").select("rid", "n", "name"))
        left *= 2
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return heads, scratch.save(whole, "whole")


def _grouped(docs: DataFrame, scratch: Scratch, block_bytes: int, block_hash) -> DataFrame:
    """(doc_id, text_key, sha, best, size): best is of the row that stays, null where a text is alone; size is too."""
    heads, names = name_texts(docs.select("doc_id", "text"), scratch, block_bytes, block_hash)
    named = scratch.save(heads.select("doc_id", "text_key", "rid").join(names, "rid"), "named")
    groups = named.groupBy("n", "name").agg(F.max(F.struct("doc_id", "text_key", "rid")).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = scratch.save(groups, "groups")
    found = with_group(named.select("rid", "n", "name"), groups, ["n", "name"], "rid").where("g is not null").select("rid", "g.best", "g.size")
    return heads.join(found, "rid", "left").withColumn("kept", F.col("best").isNull() | (F.col("rid") == F.col("best.rid")))


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash=xxhash.xxh3_64_intdigest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text, ...).

    Null text counts as empty, and empty texts are equal. Of equal texts the row with the largest
    doc_id is kept; of rows that share that too, the one whose text as it is has the largest xxhash64, and one of rows
    with the same text; a null doc_id is less than any other. Other columns are not read. An empty table gives no rows.
    """
    found = _grouped(docs, Scratch(docs.sparkSession, "exact-dedup"), block_bytes, block_hash)
    return found.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns; of rows alike in doc_id and text, see keep_rows."""
    scratch = Scratch(docs.sparkSession, "exact-dedup-keep")
    found = _grouped(docs, scratch, BLOCK_BYTES, xxhash.xxh3_64_intdigest).where("best is not null").select("doc_id", "text_key", "kept")
    return keep_rows(docs, found, F.xxhash64("text"), scratch)


def query(spark, sf_dir: str) -> DataFrame:
    from lodestone.session import table

    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
