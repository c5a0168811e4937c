"""Retrieval: vector top-k under several strategies, one row for each path, ranking and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions.query import Query

from .scoring import cosine, scored

#: Of each strategy, how many candidates for each result wanted, and how many at most.
BUDGETS = {1: (4, 100), 2: (3, 75), 3: (2, 50)}


def candidate_budget(strategy: int, n: int) -> int:
    per, most = BUDGETS[strategy]
    return min(n * per, most)


def vector_topk(vectors: DataFrame, query_vector: list[float], k: int) -> DataFrame:
    """The k rows of vectors (key, embedding, ...) nearest by cosine, with embedding_similarity; ties go to the lesser key."""
    q = F.array(*(F.lit(float(x)) for x in query_vector))
    near = vectors.withColumn("embedding_similarity", cosine(F.col("embedding"), q)).where("embedding_similarity is not null")
    return near.orderBy(F.desc("embedding_similarity"), "key").limit(k)


def with_rank(df: DataFrame, *order) -> DataFrame:
    """df, of bounded size, with its place in order from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def candidates(vectors: DataFrame, strategy_vectors: dict[int, list[float]], n: int) -> DataFrame:
    """All strategies' candidates: (key, embedding_similarity, strategy, rank). Strategies without a vector have none."""
    out = None
    for strategy, vector in sorted(strategy_vectors.items()):
        if vector is None:
            continue
        top = vector_topk(vectors, vector, candidate_budget(strategy, n)).select("key", "embedding_similarity")
        top = with_rank(top.withColumn("strategy", F.lit(strategy)), F.desc("embedding_similarity"), "key")
        out = top if out is None else out.unionByName(top)
    return out


def best_by_key(found: DataFrame) -> DataFrame:
    """Of each key the row with the highest similarity, the first of equal ones; position is where the key first came."""
    place = F.struct("strategy", "rank")
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("embedding_similarity"), "strategy", "rank"))
    first = F.min(place).over(Window.partitionBy("key"))
    return found.withColumn("position", first).withColumn("_nth", best).where("_nth = 1").drop("_nth")


def rank_results(df: DataFrame, n: int | None = None, threshold: float | None = None) -> DataFrame:
    """Rows (similarity, position, key, ...) by falling similarity, those at threshold or more, the first n."""
    if threshold is not None:
        df = df.where(F.col("similarity") >= threshold)
    df = df.orderBy(F.desc("similarity"), "position", "key")
    return df if n is None else df.limit(n)


def hybrid(vectors: DataFrame, contents: DataFrame, bm25: DataFrame, strategy_vectors: dict[int, list[float]], query: Query, n: int, threshold: float) -> DataFrame:
    """The n best documents: candidates by vectors, scored on their contents (key, content) and bm25 (key, bm25_score).

    Candidates number 225 at most, so they go to the scans of contents and scores, not the other way.
    Contents and scores of a key that has several are taken from the first.
    """
    found = candidates(vectors, strategy_vectors, n)
    if found is None or query.blank:
        empty = contents.sparkSession.createDataFrame([], "embedding_similarity double, strategy int, rank int, position struct<strategy:int,rank:int>, bm25_score double")
        return scored(contents.where("false").join(empty), query)
    found = F.broadcast(best_by_key(found))
    held = contents.join(found, "key", "left_semi").dropDuplicates(["key"])
    scores = bm25.join(found, "key", "left_semi").groupBy("key").agg(F.max("bm25_score").alias("bm25_score"))
    df = found.join(held, "key", "left").join(scores, "key", "left")
    df = df.withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0))).withColumn("content", F.coalesce("content", F.lit("")))
    return rank_results(scored(df, query), n, threshold)


