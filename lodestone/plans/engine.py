"""The search engine: a stored corpus, its index, and queries against both."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions import forms, text
from lodestone.functions.query import Query
from lodestone.operators import bm25, corpus, locate, report, retrieve, scoring
from lodestone.session import Scratch, ship

DEFAULT_ROOT = "./documents"
DIMENSIONS = 256


def hashed_embedding(c: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector of a text's words, without a model: each word adds to the dimension of its hash, with the sign of another.

    Words are sorted by dimension and sign between marks for all of these; how far marks are apart is how many words there are.
    """
    slot = lambda w: (F.pmod(F.xxhash64(w), F.lit(dimensions)) * 2 + F.pmod(F.hash(w), F.lit(2))).cast("int")
    marks = F.sequence(F.lit(0), F.lit(2 * dimensions))
    count = lambda at, i: F.element_at(at, i + 1) - F.element_at(at, i) - 1

    def of(dealt: Column) -> Column:
        return text.let(F.transform(marks, lambda s: F.array_position(dealt, s)), lambda at: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: (count(at, 2 * d + 1) - count(at, 2 * d + 2)).cast("float")))

    return F.when(c.isNotNull(), text.let(F.sort_array(F.concat(F.transform(text.words(c), slot), marks)), of))


class SearchEngine:
    """index_directory, add_document, sync_with_filesystem, search and merge_results over one collection.

    embed gives the vector of a text column; the default needs no model. stems turns stemmed
    forms on. Results are DataFrames; nothing of the corpus comes to the driver but what a report shows.
    """

    def __init__(self, spark: SparkSession, path: str, collection: str = "documents", index_path: str | None = None, embed: Callable[[Column], Column] = hashed_embedding, stems: bool = False):
        ship(spark)
        self.spark, self.embed, self.stems = spark, embed, stems
        self.collection = corpus.Collection(spark, f"{path.rstrip('/')}/{collection}")
        self.stored = bm25.StoredIndex(spark, f"{path.rstrip('/')}/{collection}-index")
        self.warnings: list[str] = []
        given = os.path.abspath(index_path) if index_path else None
        self.index_path, differs = self.collection.index_path(given, os.path.abspath(DEFAULT_ROOT))
        if differs:
            self.warnings.append(f"index path {given} differs from the stored {self.index_path}, which is used")

    # --- writing ---------------------------------------------------------------------------

    def _rows(self, found: DataFrame) -> DataFrame:
        rows = corpus.corpus_rows(found, self.index_path, self.stems)
        return rows.withColumn("embedding", self.embed(F.col("document")).cast("array<float>"))

    def _version(self) -> str:
        """The collection's state, which an index notes that is in step with it."""
        return str(max(self.collection.versions(), default=0))

    def rebuild_index(self) -> None:
        """Fits BM25 on cleaned contents. An empty collection leaves the old index."""
        docs = self._contents(self.collection.read())
        if not docs.isEmpty():
            self.stored.change(docs, note=self._version(), whole=True)

    def _current(self) -> bm25.Index:
        """The stored index. It is fitted anew only where a change to the collection broke off before the index had it."""
        if self.stored.segments.note != self._version():
            self.rebuild_index()
        return self.stored.index()

    def _contents(self, rows: DataFrame) -> DataFrame:
        """(doc_id, text): a path's cleaned content, or where that is empty what is stored."""
        content = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.col("document"))
        return rows.select(F.col("file_path").alias("doc_id"), content.alias("text")).dropDuplicates(["doc_id"])

    def change(self, new: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Rows of the collection come, once those of the paths in gone (file_path) have left; the index follows.

        Both write what belongs to the change. new is read twice, so it should be a table.
        """
        note = self.stored.segments.note
        in_step = note == self._version() if self.collection.versions() else note is None
        self.collection.change(new, gone)
        if in_step:
            self.stored.change(None if new is None else self._contents(new), None if gone is None else gone.select(F.col("file_path").alias("doc_id")), self._version())
        else:
            self.rebuild_index()

    def index_directory(self, directory: str, replace: bool = True) -> int:
        """Reads all files under directory; the number read. replace: rows of the same paths go first."""
        self.index_path = os.path.abspath(directory)
        # Files are read once, into a table.
        scratch = Scratch(self.spark, "ingest")
        new = scratch.save(self._rows(corpus.files(self.spark, self.index_path)), "rows")
        n = new.count()
        if n:
            self.change(new, new.select("file_path") if replace else None)
        scratch.drop(new)
        return n

    def add_document(self, content: str, title: str | None = None, now: datetime | None = None) -> str:
        """Writes a file under the index path and adds it; its path."""
        os.makedirs(self.index_path, exist_ok=True)
        stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
        row = self.spark.range(1).select(text.safe_name(F.lit(title), F.lit(content)).alias("name"), text.titled(F.lit(title), F.lit(content)).alias("body")).first()
        path = os.path.join(self.index_path, f"{row.name}_{stamp}.md")
        with open(path, "w", encoding="utf-8") as f:
            f.write(row.body)
        found = self.spark.createDataFrame([(path, os.path.basename(path), os.path.getsize(path), row.body)], "file_path string, filename string, size long, content string")
        # Such documents are stored as they are, not in their three-part representation.
        added = self._rows(found).withColumns({"title": F.lit(title or ""), "document": F.lit(row.body)})
        self.change(added.withColumn("embedding", self.embed(F.col("document")).cast("array<float>")))
        return path

    def sync_with_filesystem(self) -> DataFrame | None:
        """Makes the collection what lies under the index path; (path, action), or None where that is missing."""
        if not os.path.exists(self.index_path):
            self.warnings.append(f"index path {self.index_path} does not exist")
            return None
        listed = corpus.listing(self.spark, self.index_path)
        old = self.collection.read().select(F.col("file_path").alias("path"), "size")
        scratch = Scratch(self.spark, "sync")
        # A table, so that it still tells what was done once it is done.
        plan = scratch.save(corpus.sync_plan(old, listed.select(F.col("file_path").alias("path"), "size")), "plan")
        changes = plan.where("action <> 'keep'")
        if not changes.isEmpty():
            # Only files that came or changed are opened.
            came = listed.join(plan.where("action in ('insert', 'update')").select(F.col("path").alias("file_path")), "file_path", "left_semi")
            new = scratch.save(self._rows(corpus.contents(came)), "rows")
            self.change(new, changes.where("action <> 'insert'").select(F.col("path").alias("file_path")))
            scratch.drop(new)
        return plan

    # --- reading ---------------------------------------------------------------------------

    def _vector(self, words: str) -> list[float] | None:
        return self.spark.range(1).select(self.embed(F.lit(words)).alias("v")).first().v if words else None

    def _strategy(self, number: int, words: str) -> list[float] | None:
        """The vector of a strategy. One that fails leaves its candidates to the others, and a warning."""
        try:
            return self._vector(words)
        except Exception as error:
            self.warnings.append(f"strategy {number} failed: {error}")
            return None

    def search(self, query: str, n: int = 5, threshold: float = 0.7) -> DataFrame:
        """The n best documents of at least threshold, by rank.

        (rank, file_path, metadata, document, embedding_similarity, original_query, similarity,
        similarity_breakdown, bm25_score). A blank query has no results.
        """
        if not isinstance(n, int) or n < 0:
            raise ValueError("the number of results must be a whole number from 0 on")
        q = Query(query, self.stems)
        rows = self.collection.read()
        vectors = rows.select(F.col("file_path").alias("key"), "embedding")
        meta = rows.select(F.col("file_path").alias("key"), "content", F.struct("filename", "file_path", "size", "index_path", "title").alias("metadata"))
        if q.blank or n == 0 or not self.collection.segments.totals()[0]:
            strategies, scores = {}, self.spark.createDataFrame([], "key string, bm25_score double")
        else:
            strategies = {1: self._strategy(1, q.expanded), 2: self._strategy(2, q.concept_text), 3: self._strategy(3, q.lowered)}
            scores = self._current().score(q).select(F.col("doc_id").alias("key"), F.col("bm25").alias("bm25_score"))
        best = retrieve.hybrid(vectors, meta, scores, strategies, q, n, threshold)
        ranked = retrieve.with_rank(best, F.desc("similarity"), "position", "key")
        if self.stems:
            ranked = ranked.withColumn("_stems", forms.stem_map(F.array_distinct(text.words(F.col("content")))))
        return ranked.select(
            "rank",
            F.col("key").alias("file_path"),
            "metadata",
            locate.display(F.col("content"), q, F.col("_stems") if self.stems else None).alias("document"),
            "embedding_similarity",
            F.lit(query).alias("original_query"),
            "similarity",
            "similarity_breakdown",
            "bm25_score",
        )

    def text_report(self, results: DataFrame) -> str:
        return report.text_report(results)

    def command_report(self, results: DataFrame) -> str:
        return report.command_report(results)

    def json_report(self, results: DataFrame) -> str:
        return report.json_report(results)

    def merge_results(self, results: DataFrame) -> str:
        return report.merged_report(results)

    def similarity(self, docs: DataFrame, query: str) -> DataFrame:
        """docs (content, embedding_similarity, bm25_score, ...) with similarity_breakdown and similarity."""
        return scoring.scored(docs, Query(query, self.stems))
