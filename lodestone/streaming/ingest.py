"""Ingestion of arriving files as a stream.

Files that appear under a folder are read as they come; each micro-batch replaces the rows of its
paths. A stream of files tells of no deletions, so synchronisation of the whole folder stays the
authority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.vocab import EXTENSIONS
from lodestone.plans.engine import SearchEngine
from lodestone.session import Scratch


def arriving(engine: SearchEngine, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(file_path, filename, size, content) of files as they appear."""
    spark = engine.spark
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    name = F.element_at(F.split("path", "/"), -1)
    known = F.array_contains(F.transform(F.array(*map(F.lit, EXTENSIONS)), lambda e: F.endswith(F.lower(F.col("path")), e)), True)
    return raw.where(known).select(path.alias("file_path"), name.alias("filename"), F.col("length").alias("size"), F.expr("replace(make_valid_utf8(cast(content as string)), '�', '')").alias("content"))


def start(engine: SearchEngine, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts ingestion; with available_now it ends when all files there have been read."""

    def batch(found: DataFrame, number: int) -> None:
        scratch = Scratch(engine.spark, "arrived")
        new = scratch.save(engine._rows(found), "rows")
        engine.change(new, new.select("file_path"))
        scratch.drop(new)

    writer = arriving(engine, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
