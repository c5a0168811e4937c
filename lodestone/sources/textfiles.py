"""A data source for text files: every file under a folder, whatever its name or size.

Spark's own file sources leave out empty files and names that begin with a dot or underscore; a corpus
has them all. The folder is listed once; tasks then read the files in batches. Bytes that are not
UTF-8 are dropped, and all line ends become LF.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.vocab import EXTENSIONS

#: Files are dealt to tasks up to so many bytes or files.
BATCH_BYTES, BATCH_FILES = 32_000_000, 2_000


class _Batch(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


def listed(root: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of the files under root, sorted by path."""
    out = []
    for folder, _, names in os.walk(os.path.abspath(root)):
        for name in names:
            if name.lower().endswith(endings):
                path = os.path.join(folder, name)
                try:
                    out.append((path, os.path.getsize(path)))
                except OSError:  # gone meanwhile
                    continue
    return sorted(out)


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def read_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file_path, filename, size) with the files' content, a row at a time; a file that can't be read is passed over."""
    for batch in batches:
        for row in batch.to_pylist():
            try:
                with open(row["file_path"], "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_pydict({"file_path": [row["file_path"]], "filename": [row["filename"]], "size": pa.array([row["size"]], pa.int64()), "content": [decoded(raw)]})


class TextFiles(DataSource):
    """spark.read.format("textfiles").load(folder); options: endings, comma-separated file endings, and contents, false for a listing alone."""

    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def schema(self) -> str:
        return "file_path string, filename string, size long" + (", content string" if _contents(self.options) else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _contents(options) -> bool:
    return options.get("contents", "true").lower() != "false"


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.contents = options["path"], _contents(options)
        self.endings = tuple(e for e in options.get("endings", ",".join(EXTENSIONS)).split(",") if e)

    def partitions(self):
        batches, now, size = [], [], 0
        for path, n in listed(self.root, self.endings):
            if now and (size + n > BATCH_BYTES or len(now) >= BATCH_FILES):
                batches.append(_Batch(now))
                now, size = [], 0
            now.append((path, n))
            size += n
        return [*batches, _Batch(now)] if now or not batches else batches

    def read(self, partition):
        if not partition.files:
            return
        paths, sizes = zip(*partition.files, strict=True)
        listed = pa.RecordBatch.from_pydict({"file_path": list(paths), "filename": list(map(os.path.basename, paths)), "size": pa.array(sizes, pa.int64())})
        yield from read_files([listed]) if self.contents else [listed]
