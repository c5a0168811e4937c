"""Exact top-k by inner product, with vectors in order of length and residual bounds.

Components become integers, so scores are exact. Vectors are dealt by descending length into blocks.
The block of the longest vectors is held against all queries first, which gives each query a floor: its k-th score so
far. A block of queries then meets only the blocks whose largest length, times the length of one of these queries,
reaches that query's floor. In rotated coordinates (the SVD of the second-moment matrix, which orders directions by
how much length they hold) a partial inner product plus the product of the lengths that are left bounds a score from
above, by Cauchy-Schwarz; only vectors whose bound reaches the floor are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import Scratch, table

from .workers import tidy

SCALE, K, EVERY = 1024, 10, 100
#: Vectors of a block, and queries of a block.
BLOCK, QUERIES = 4096, 1024
#: Rotated coordinates of the first partial sum.
HEAD = 16
#: Classes of lengths, an eighth of an octave each, and parts in which blocks of a class meet their queries.
CLASSES, SALTS = 512, 16
_SLACK = 1e-9


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """Integer components, or null for vectors that are null or hold null or non-finite components."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale)))


@tidy
def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x = _matrix(batch.column("x"))
        if total is None or total.shape[0] < x.shape[1]:
            grown = np.zeros((x.shape[1],) * 2)
            if total is not None:
                grown[: len(total), : len(total)] = total
            total = grown
        total[: x.shape[1], : x.shape[1]] += x.T @ x
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "m"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows padded with zeros to the longest."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def rotation(vectors: DataFrame) -> np.ndarray:
    """Directions by falling share of the vectors' squared length, from all of them."""
    rows = vectors.select("x").mapInArrow(_moments, "i long, j long, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
    size = max((r.i for r in rows), default=-1) + 1
    moment = np.zeros((size, size))
    for r in rows:
        moment[r.i, r.j] = r.m
    return np.linalg.svd(moment)[0] if size else moment


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _exact(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Inner products of rows of x with the vector y, as whole numbers within 64 bits."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2.0**53:
        return (x @ y).astype(np.int64).tolist()
    big = [sum(int(a) * int(b) for a, b in zip(row, y, strict=True)) for row in x]
    return [max(-(2**63), min(2**63 - 1, v)) for v in big]


def block_topk(q_ids, q, ids, x, basis: np.ndarray, k: int, floors) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score): each query's k best of this block; fewer where floors[i] shows that they can't count."""
    width = len(basis)
    q, x = _padded(q, width), _padded(x, width)
    order = np.lexsort((ids, -np.einsum("ij,ij->i", x, x)))
    ids, x = ids[order], x[order]
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    rx, rq = x @ basis, q @ basis
    head = min(HEAD, width)
    rest_x, rest_q = (np.sqrt(np.clip(np.einsum("ij,ij->i", r[:, head:], r[:, head:]), 0, None)) for r in (rx, rq))
    for i, own in enumerate(q_ids):
        size = float(np.sqrt(q[i] @ q[i]))
        best: list[tuple[int, int]] = []
        floor = -np.inf if floors[i] is None else floors[i]
        for a in range(0, len(ids), 512):
            slack = _SLACK * size * length[a] + 1e-6
            if size * length[a] + slack < floor:
                break
            part = slice(a, a + 512)
            bound = rx[part, :head] @ rq[i, :head] + rest_x[part] * rest_q[i] + slack
            near = np.flatnonzero((bound >= floor) & (ids[part] != own)) + a
            best += [(-s, int(v)) for s, v in zip(_exact(x[near], q[i]), ids[near], strict=True)]
            best = sorted(best)[:k]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        for s, v in best:
            yield own, v, -s


def _cells(batch: pa.RecordBatch, row: int, ids: str, x: str) -> tuple[np.ndarray, np.ndarray]:
    i, v = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in ((ids, "<i8"), (x, "<f8")))
    return i, v.reshape(len(i), -1)


def least_length(q: np.ndarray, floors: np.ndarray) -> float:
    """Vectors shorter than this reach no floor of the queries q."""
    size = np.sqrt(np.einsum("ij,ij->i", q, q))
    if not len(q) or not size.all() or np.isneginf(floors).any():
        return float("-inf")
    return float(((floors - 1e-6) / (size * (1 + 1e-6))).min())


def _begin(sent, k: int):
    """(q_ids, q, a) with each query's hits in the first block, its floor, and the least length of vectors that may reach one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, ids, x = sent.value
        kind = pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
        for batch in batches:
            hits, floors, least = [], [], []
            for row in range(batch.num_rows):
                q_ids, q = _cells(batch, row, "q_ids", "q")
                own, floor = [], np.full(len(q_ids), -np.inf)
                for i in range(len(q_ids)):
                    found = list(block_topk(q_ids[i : i + 1], q[i : i + 1], ids, x, basis, k, [None]))
                    own += [{"query_id": int(a), "vec_id": v, "score": s} for a, v, s in found]
                    if len(found) == k:
                        floor[i] = found[-1][2]
                hits.append(own)
                floors.append(floor.tobytes())
                least.append(least_length(q, floor))
            cols = [*(batch.column(c) for c in ("q_ids", "q", "a")), pa.array(floors, pa.binary()), pa.array(least, pa.float64()), pa.array(hits, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["q_ids", "q", "a", "floors", "least", "hits"])

    return run


def _meet(sent, k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = sent.value[0]
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in range(batch.num_rows):
                q_ids, q = _cells(batch, row, "q_ids", "q")
                floors = np.frombuffer(batch.column("floors")[row].as_buffer(), "<f8")
                out += block_topk(q_ids, q, *_cells(batch, row, "ids", "x"), basis, k, floors)
            cols = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def _length_class(length: Column) -> Column:
    """Lengths as at most CLASSES whole numbers that don't fall as lengths grow; 0 for all that are less than any."""
    return F.when(length < 1, 0).otherwise(F.least(F.lit(CLASSES - 1), 1 + F.floor(F.log2(length) * 8))).cast("int")


def open_pairs(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b): blocks of queries (a, least) with the blocks of vectors (b, longest) that may reach a floor.

    Queries go to the classes of lengths that they need, of which there are CLASSES at most, and to each of SALTS parts of these.
    """
    needs = asked.select("a", "least", F.explode(F.sequence(_length_class(F.col("least")), F.lit(CLASSES - 1))).alias("class"))
    held = blocks.select("b", "longest", _length_class(F.col("longest")).alias("class"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    needs = needs.join(held.select("class").distinct(), "class", "left_semi")
    needs = needs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return needs.join(held, ["class", "salt"]).where("longest >= least").select("a", "b")


def _packed(size: int, names: tuple[str, str]):
    """(vec_id, x) to blocks of at most size rows, in the order of the partition, with the largest length in each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts):
            both = pa.Table.from_batches(parts).combine_chunks()
            x = _matrix(both.column("x").chunk(0) if both.column("x").num_chunks else both.column("x").combine_chunks())
            ids = both.column("vec_id").to_numpy().astype("<i8")
            longest = float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
            return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.large_binary()), pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.large_binary()), pa.array([longest])], [*names, "longest"])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries, its k best of vectors (vec_id, embedding, ...).

    Both have whole-number vec_id. A query never finds rows with its own vec_id. Ties go to the smaller vec_id. Null ids and
    vectors that are null or hold null or non-finite components take no part; vectors of other sizes are
    padded with zeros. Scores past 64 bits stop there. Rows that repeat are found as often. An
    empty side gives no rows. Queries may be many: they are dealt in blocks of their own, and only
    blocks of bounded size meet, of which none need to where the lengths rule a pair out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")

    def whole(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("x")).where("vec_id is not null and x is not null")

    fine = whole(vectors).withColumn("size", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    sorted_ = scratch.save(fine.repartitionByRange(F.desc("size"), "vec_id").sortWithinPartitions(F.desc("size"), "vec_id").select("vec_id", "x"), "sorted")
    basis = rotation(sorted_)
    if not len(basis):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = sorted_.mapInArrow(_packed(block, ("ids", "x")), "ids binary, x binary, longest double").withColumn("b", F.monotonically_increasing_id())
    blocks = scratch.save(blocks, "blocks")
    # One block goes to all tasks: at most so many vectors.
    first = blocks.orderBy(F.desc("longest"), "b").limit(1).toArrow()
    number = first.column("b")[0].as_py()
    sent = spark.sparkContext.broadcast((basis, *_cells(first.to_batches()[0], 0, "ids", "x")))
    asked = whole(queries).repartition("vec_id").mapInArrow(_packed(QUERIES, ("q_ids", "q")), "q_ids binary, q binary, longest double").drop("longest").withColumn("a", F.monotonically_increasing_id())
    asked = scratch.save(asked, "queries")
    asked = asked.mapInArrow(_begin(sent, k), "q_ids binary, q binary, a long, floors binary, least double, hits array<struct<query_id:long,vec_id:long,score:long>>")
    asked = scratch.save(asked, "begun")
    pairs = open_pairs(asked, blocks.where(F.col("b") != number))
    # Numbers of blocks are dealt out before any vector moves.
    met = pairs.repartition("a", "b").join(asked.drop("hits", "least"), "a").join(blocks, "b").select("q_ids", "q", "floors", "ids", "x")
    found = met.mapInArrow(_meet(sent, k), "query_id long, vec_id long, score long")
    found = found.unionByName(asked.select(F.explode("hits").alias("h")).select("h.*"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 10
"""
