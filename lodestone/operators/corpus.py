"""Corpora of files: representation, listing, synchronisation and storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions import forms, text
from lodestone.functions.vocab import STOP_WORDS
from lodestone.sources.textfiles import TextFiles, read_files

from .scoring import concepts
from .segments import Segments

#: A row of the stored corpus. embedding is null until one is supplied.
SCHEMA = "id string, file_path string, filename string, size long, index_path string, title string, document string, content string, embedding array<float>"


def _full_forms(tokens: Column, stems: Column | None = None) -> Column:
    """The sorted base forms of tokens of three letters and more that aren't stop words; of one token, they may be one string with spaces."""
    wanted = F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))
    if stems is None:  # few words have two forms: no list for each word
        return F.transform(wanted, forms.joined_base_forms_of)
    return F.flatten(F.transform(wanted, lambda t: forms.sorted_base_forms_of(t, stems)))


def with_embedding_text(df: DataFrame, source: str, name: str, stems: bool = False) -> DataFrame:
    """df with the column name: symbols apart, operators by name, lower case; tokens longer than one, then full forms of words."""
    spelled = F.lower(text.unify_lines(text.verbalize_operators(text.apart(F.col(source)))))  # white space is cut at in any case
    told = df.withColumn("_tokens", text.tokens(spelled))
    if stems:
        told = told.withColumn("_stems", forms.stem_map(F.array_distinct("_tokens")))
    long = F.filter("_tokens", lambda t: F.length(t) > 1)
    return told.withColumn(name, F.array_join(F.concat(long, _full_forms(F.col("_tokens"), F.col("_stems") if stems else None)), " ")).drop("_tokens", "_stems")


def search_text(c: Column) -> Column:
    """Tokens longer than one, then all forms of words without symbols."""
    plain = text.tokens(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\p{Z}\t-\r\x1c-\x1f\x85]", " "))
    wanted = F.filter(text.without_stops(plain), lambda t: F.length(t) > 2)
    own = F.filter(text.tokens(F.lower(c)), lambda t: F.length(t) > 1)
    return F.array_join(F.concat(own, F.flatten(F.transform(wanted, forms.forms_of_one))), " ")


def with_representation(df: DataFrame, source: str, name: str, stems: bool = False) -> DataFrame:
    """df with what is stored of a file: its cleaned text, its embedding text, and all forms of its concepts.

    Steps are columns of their own, so that each is worked out once.
    """
    df = with_embedding_text(df.withColumn("_clean", text.clean(F.col(source))), "_clean", "_spelled", stems)
    if stems:
        df = df.withColumn("_stems", forms.stem_map(F.array_distinct(text.words(F.col("_spelled")))))
    known = F.col("_stems") if stems else None
    df = df.withColumn("_concepts", concepts(F.col("_spelled"), known))
    df = df.withColumn("_forms", forms.forms_of(F.col("_concepts"), known))
    variants = F.sort_array(F.array_distinct(F.concat("_concepts", "_forms")))
    whole = F.concat_ws(" ", "_clean", "_spelled", F.when(F.size("_concepts") > 0, F.array_join(variants, " ")))
    return df.withColumn(name, whole).drop("_clean", "_spelled", "_concepts", "_forms", "_stems")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, filename, size, content) of all files under root with a known ending, empty and hidden ones too."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("textfiles").load(root)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, filename, size) of the same files; none of them is opened."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("textfiles").option("contents", "false").load(root)


def contents(listed: DataFrame) -> DataFrame:
    """Files of a listing, with their content, dealt out by path. Those that can't be read are left out."""
    # With a number, as Spark would merge partitions by the few bytes that a listing has.
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("file_path", "filename", "size").repartition(tasks, "file_path").mapInArrow(read_files, "file_path string, filename string, size long, content string")


def corpus_rows(found: DataFrame, root: str, stems: bool = False) -> DataFrame:
    """Files as rows of the stored corpus. The id is a hash of the path, so a file that is read again has its old id."""
    return with_representation(found, "content", "document", stems).select(
        F.sha2("file_path", 256).alias("id"),
        "file_path",
        "filename",
        "size",
        F.lit(root).alias("index_path"),
        F.lit(None).cast("string").alias("title"),
        "document",
        text.clean(F.col("content")).alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


# --- differences of two states -------------------------------------------------------------


def new_paths(db: DataFrame, fs: DataFrame) -> DataFrame:
    return fs.select("path").distinct().join(db, "path", "left_anti")


def removed_paths(db: DataFrame, fs: DataFrame) -> DataFrame:
    return db.select("path").distinct().join(fs, "path", "left_anti")


def kept_paths(db: DataFrame, fs: DataFrame) -> DataFrame:
    return db.select("path").distinct().join(fs, "path", "left_semi")


def changed_paths(db: DataFrame, fs: DataFrame) -> DataFrame:
    """Paths in both whose sizes differ, and paths of fs that db doesn't know."""
    old = db.groupBy("path").agg(F.min("size").alias("old"))
    return fs.join(old, "path", "left").where(F.coalesce(F.col("old") != F.col("size"), F.lit(True))).select("path").distinct()


def sync_plan(db: DataFrame, fs: DataFrame) -> DataFrame:
    """(path, action) for every path of db and fs (path, size): insert, delete, update or keep. One join, one shuffle of each side."""
    old = db.groupBy("path").agg(F.min("size").alias("old"))
    new = fs.groupBy("path").agg(F.min("size").alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return old.join(new, "path", "full_outer").select("path", action.alias("action"))


# --- storage -------------------------------------------------------------------------------


class Collection:
    """A stored corpus, by file paths, as segments: a change writes its own rows, whatever the collection's size.

    A path may have several rows; those of one path leave together.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.segments = Segments(spark, path, "file_path", {"rows": SCHEMA}, "size")

    def versions(self) -> list[int]:
        return self.segments.versions()

    def read(self) -> DataFrame:
        """The rows; none where nothing has been written."""
        return self.segments.read()

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """rows come, once those of the paths in gone (file_path) have left."""
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        self.segments.change(None if rows is None else {"rows": rows.select(*columns)}, gone)

    def append(self, rows: DataFrame) -> None:
        self.change(rows)

    def delete(self, paths: DataFrame) -> None:
        """Rows whose file_path is in paths (path) go."""
        self.change(gone=paths.select(F.col("path").alias("file_path")))

    def index_path(self, given: str | None, default: str) -> tuple[str, bool]:
        """The folder of the first row that has one, else the one given, else default; and whether given differs."""
        row = self.read().where("index_path is not null").select(F.min("index_path").alias("p")).first()
        if row is None or row.p is None:
            return given or default, False
        return row.p, bool(given) and given != row.p
