"""Connected components by alternating large and small stars, on DataFrames only but for the first step.

Edges first fall into stars within each task, which is all there is to do where one task holds them all. Stars
of different tasks are then joined, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestone.session import Scratch

from .workers import tidy

#: Edges that a task joins at a time.
AT_ONCE = 500_000


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the least of its component, with the least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)].tolist(), at[len(u) :].tolist()
    up = list(range(len(nodes)))
    for x, y in zip(a, b, strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    for i, x in enumerate(up):  # a node's parent is less, so its root is known
        up[i] = up[x]
    root = np.array(up, np.int64)
    other = np.flatnonzero(root != np.arange(len(root)))
    return nodes[other], nodes[root[other]]


@tidy
def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) to (u, v, part): stars of the edges of a task, AT_ONCE at a time."""
    part = TaskContext.get().partitionId()
    held, n = [], 0

    def out():
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        u, v = _stars(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), part, np.int64))], ["u", "v", "part"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield out()
            part, held, n = part + (1 << 32), [], 0
    if n:
        yield out()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; edges are distinct."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    both = edges.select(ends).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # Each edge (u, v) gives (v, m) and (u, m).
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
    return down.join(least, "u").select(ends).select("e.u", "e.v").where("u <> v")


def _joined_stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Stars of all edges; a round's rows never exceed twice the edges."""
    now = scratch.save(edges.select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        new = scratch.save(_small_star(_large_star(now).distinct()).distinct(), "stars")
        scratch.drop(now)
        now, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    return now


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is its least reachable node.

    u and v are whole numbers or strings. Rows with a null end and self loops add no node; repeated and reversed edges
    count once; no edges give no rows. Each round is a written table, so a node with very many edges costs no more than its edges.
    """
    now = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    if now.schema["u"].dataType.simpleString() == "bigint":
        stars = scratch.save(now.mapInArrow(_contracted, "u long, v long, part long"), "contracted")
        if stars.agg(F.count_distinct("part").alias("n")).first().n > 1:
            stars = _joined_stars(stars, scratch)
    else:
        stars = _joined_stars(now, scratch)
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
