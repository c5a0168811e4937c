"""Runs a table of saved searches over all documents and writes each one's best results.

    python -m jobs.saved_searches --documents IN --queries Q --results OUT

IN holds Parquet files (doc_id, text, ...), Q a table of searches: a key, which the config names, and text. All searches are
scored together, by BM25, in passes over the documents. OUT is partitioned by part, the hash of the search's key,
so that who reads one search reads one folder:

    OUT/part=P    (query_id, rank, doc_id, bm25, component, n_terms, line, line_terms)

component is the score as hybrid ranking takes it; line is the first line that has most of the search's terms. A run replaces
all of OUT, so a run that broke off is started again, and two runs over the same tables write the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import bm25
from lodestone.session import Scratch

from .common import defaults, options

log = logging.getLogger("jobs.saved_searches")


def results(docs: DataFrame, queries: DataFrame, config: dict, scratch: Scratch) -> DataFrame:
    """(query_id, rank, doc_id, bm25, component, n_terms, line, line_terms): up to top rows for each search (query_id, text)."""
    # The few best are written down: they are joined twice, and their size then tells that no text need move.
    best = scratch.save(bm25.Index.fit(docs).search_many(queries, config["top"], config["least"]), "best")
    best = bm25.best_lines(best.withColumn("component", F.round(bm25.squash(F.col("bm25")), 6)), docs, queries)
    return best.select("query_id", "rank", "doc_id", "bm25", "component", "n_terms", "line", "line_terms")


def run(spark: SparkSession, documents: str, queries: str, target: str, config: dict | None = None) -> int:
    """Writes the results of all searches to target; how many rows there are."""
    config = {**defaults("saved_searches"), **(config or {})}
    docs = spark.read.parquet(documents).select("doc_id", "text")
    asked = spark.read.parquet(queries).select(F.col(config["query_key"]).alias("query_id"), "text")
    log.info("%d searches of %s over %d documents of %s", asked.count(), queries, docs.count(), documents)
    scratch = Scratch(spark, "saved")
    found = results(docs, asked, config, scratch).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(config["parts"])).cast("int"))
    found.repartition("part").sortWithinPartitions("query_id", "rank").write.mode("overwrite").partitionBy("part").parquet(target)
    scratch.clear()
    written = read(spark, target).count()
    log.info("%d results written to %s", written, target)
    return written


def read(spark: SparkSession, target: str) -> DataFrame:
    """The results written last."""
    kinds = "query_id long, rank int, doc_id long, bm25 double, component double, n_terms long, line int, line_terms int, part int"
    return spark.read.schema(kinds).parquet(target)


def main() -> None:
    from lodestone.session import session

    args = options("saved_searches", "Runs saved searches over all documents.", {"documents": "Parquet files (doc_id, text)", "queries": "Parquet files of searches", "results": "where results go"})
    spark = session(args.master, "saved_searches") if args.master else session(app="saved_searches")
    try:
        run(spark, args.documents, args.queries, args.results, args.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
