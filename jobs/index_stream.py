"""Keeps a search index in step with a folder of documents that arrive.

    python -m jobs.index_stream --documents IN --index OUT --checkpoint CP

IN is a folder of Parquet files (doc_id, text, ...), or a pattern of files. Each run takes the files that have come since the last one, as a stream with a
checkpoint, and adds their postings: IN may be of any size, a run costs what is new. A document that comes again replaces
the one before, by the time of its file within a run and in any case in a later one. Every micro-batch writes folders of its own number and nothing else:

    OUT/lengths/batch=N              (doc_id, dl) of the batch's documents
    OUT/postings/batch=N/bucket=B    (doc_id, term, tf, dl), sorted by term; a term is in one bucket

A batch that is run again writes the same folders with the same rows, so a run that broke off is simply started again. The
batch of the highest number that has a document counts; index() reads that state. A batch that broke off may have left one
of its folders; the next run replaces it. OUT and CP belong together: with a new checkpoint, take a new OUT.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import bm25

from .common import defaults, options

log = logging.getLogger("jobs.index_stream")
LENGTHS, POSTINGS = "doc_id long, dl long, batch int", "doc_id long, term string, tf long, dl long, batch int, bucket int"


def latest(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one row for each id of docs (doc_id, text, came), the one that came last; of equal times the one whose text has the largest xxhash64.

    Rows without an id are left out; a null text is empty. Only texts of ids that repeat are gathered, so while these are few no text moves.
    """
    known = docs.where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    again = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    last = known.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", F.struct("came", F.xxhash64("text"))).alias("text"))
    return known.join(again, "doc_id", "left_anti").select("doc_id", "text").unionByName(last)


def add_batch(docs: DataFrame, number: int, target: str, config: dict) -> None:
    """Writes the folders of one batch of documents."""
    spark = docs.sparkSession
    lengths, postings = f"{target}/lengths/batch={number}", f"{target}/postings/batch={number}"
    rows = latest(docs)
    bucket = F.pmod(F.xxhash64("term"), F.lit(config["buckets"])).cast("int")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(config["files_per_bucket"]))
    found = bm25.weighed_postings(rows).withColumn("bucket", bucket).withColumn("spread", spread)
    # A bucket's rows go to several tasks, so that a term of all documents doesn't burden one, and to the more the more rows there are.
    dealt = found.hint("rebalance", F.col("bucket"), F.col("spread")).drop("spread").sortWithinPartitions("bucket", "term", "doc_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(postings)
    bm25.doc_stats(rows).write.mode("overwrite").parquet(lengths)
    log.info("batch %d: %d rows read, %d documents and %d postings written to %s", number, docs.count(), spark.read.parquet(lengths).count(), spark.read.schema("doc_id long").parquet(postings).count(), target)


def run(spark: SparkSession, documents: str, target: str, checkpoint: str, config: dict | None = None) -> int:
    """Takes what is new in documents into the index at target; how many batches that took. Ends when all has been read."""
    config = {**defaults("index_stream"), **(config or {})}
    log.info("documents of %s since the last run on %s", documents, checkpoint)
    source = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    batches: list[int] = []

    def batch(docs: DataFrame, number: int) -> None:
        add_batch(docs, number, target, config)
        batches.append(number)

    query = source.select("doc_id", "text", F.col("_metadata.file_modification_time").alias("came")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches", len(batches))
    return len(batches)


def live(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, dl, batch): the state of each document."""
    rows = spark.read.schema(LENGTHS).parquet(f"{target}/lengths")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("dl", "batch"), "batch").alias("last")).select("doc_id", "last.dl", "last.batch")


def postings(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, term, tf, dl, bucket) of the documents as they are now; a filter on bucket or term reaches the files."""
    rows = spark.read.schema(POSTINGS).parquet(f"{target}/postings")
    return rows.join(live(spark, target).select("doc_id", "batch"), ["doc_id", "batch"]).select("doc_id", "term", "tf", "dl", "bucket")


def index(spark: SparkSession, target: str) -> bm25.Index:
    """The index as it is now, to be searched."""
    held, docs = postings(spark, target), live(spark, target)
    corpus = docs.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(corpus.select("n_docs")))
    return bm25.Index(held.drop("bucket"), terms.select("term", "df", "cf", bm25.idf(F.col("df"), F.col("n_docs")).alias("idf")), corpus)


def main() -> None:
    from lodestone.session import session

    args = options("index_stream", "Keeps a search index in step with documents that arrive.", {"documents": "a folder of Parquet files", "index": "where the index is", "checkpoint": "the stream's checkpoint"})
    spark = session(args.master, "index_stream") if args.master else session(app="index_stream")
    try:
        run(spark, args.documents, args.index, args.checkpoint, args.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
