"""Annotated text as a data source: spark.read and spark.readStream .format("annotated_text") on a folder.

A task reads a group of files and yields Arrow batches. Columns that a schema leaves out aren't parsed: ids and comments alone need
no look at the words. Files are found by the driver (names, sizes and times only) through the file system that the path names; tasks must
reach it as well. On stores that only Spark's own readers open, sources.text.read_annotated() gives the same rows.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tsumugi.kernels import formats
from tsumugi.schema import SENTENCE

#: Sentences of a batch: a file is read line by line, so this is what a task holds.
AT_ONCE = 256
#: Columns that are read off a sentence's comment line.
LIGHT = frozenset({"path", "doc_id", "sent_idx", "sid", "comment"})


def full_schema() -> str:
    """All columns: the path, the document, the place in the file, and those of a sentence."""
    return f"path string, doc_id string, sent_idx int, {_top_level(SENTENCE)}"


def _top_level(kind: str) -> str:
    depth, out, name = 0, [], ""
    for c in kind.removeprefix("struct<").removesuffix(">"):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(name)
            name = ""
        else:
            name += c
    return ", ".join(x.replace(":", " ", 1) for x in [*out, name])


class File(NamedTuple):
    path: str
    size: int
    time: int


class Group(InputPartition):
    """Files of one task."""

    def __init__(self, uri: str, paths: list[str]):
        self.uri, self.paths = uri, paths


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def found(uri: str, glob: str, recursive: bool) -> list[File]:
    """The files of a folder (or the one file) whose names fit, in the order of their paths."""
    store, path = opened(uri)
    at = store.get_file_info(path)
    infos = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=recursive))
    return sorted(File(i.path, i.size or 0, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob) and not i.base_name.startswith(("_", ".")))


def grouped(files: list[File], group_bytes: int) -> list[list[str]]:
    """Neighbouring files together, up to so many bytes."""
    out: list[list[str]] = []
    room = 0
    for f in files:
        if not out or f.size > room:
            out.append([])
            room = group_bytes
        out[-1].append(f.path)
        room -= f.size
    return out


def rows_of(path: str, text: str, columns: list[str]) -> list[dict]:
    """A file's sentences, with the columns that are asked for."""
    return list(sentence_rows(path, text, columns))


def sentence_rows(path: str, text: str | Iterable[str], columns: list[str]) -> Iterator[dict]:
    """As rows_of(), one at a time, of a text or its lines."""
    name = path.rsplit("/", 1)[-1]
    name = name.rsplit(".", 1)[0] if "." in name[1:] else name
    for k, lines in enumerate(formats.sentences_of(text)):
        if LIGHT.issuperset(columns):
            ids = [m for m in map(formats.SID.match, lines) if m]
            own = {"sid": ids[-1][1] if ids else None, "comment": (ids[-1][2] or None) if ids else None}
        else:
            own = formats.parse_sentence(lines)
        doc, dash, _ = (own["sid"] or "").rpartition("-")
        own |= {"path": path, "sent_idx": k, "doc_id": doc if dash and doc else name}
        yield {c: own[c] for c in columns}


class AnnotatedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.uri = schema, options["path"]
        self.glob, self.recursive = options.get("glob", "*.knp"), options.get("recursive", "false").lower() == "true"
        self.group_bytes = int(options.get("groupbytes", 64 << 20))

    def groups(self, files: list[File]) -> list[Group]:
        return [Group(self.uri, paths) for paths in grouped(files, self.group_bytes)]

    def partitions(self) -> list[Group]:
        return self.groups(found(self.uri, self.glob, self.recursive)) or [Group(self.uri, [])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        store, _ = opened(partition.uri)
        kind = to_arrow_schema(self.schema)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                rows = sentence_rows(path, io.TextIOWrapper(f, encoding="utf-8", newline="\n"), self.schema.names)
                while own := list(islice(rows, AT_ONCE)):
                    yield pa.RecordBatch.from_pylist(own, schema=kind)


class AnnotatedStreamReader(DataSourceStreamReader):
    """New files in the order of their times: an offset is the latest time and the names that have it, so it doesn't grow with the files."""

    def __init__(self, schema: StructType, options: dict):
        self.batch = AnnotatedReader(schema, options)

    def initialOffset(self) -> dict:
        return {"time": -1, "names": []}

    def latestOffset(self) -> dict:
        files = found(self.batch.uri, self.batch.glob, self.batch.recursive)
        last = max((f.time for f in files), default=-1)
        return {"time": last, "names": [f.path for f in files if f.time == last]}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        after = lambda f, o: f.time > o["time"] or f.time == o["time"] and f.path not in o["names"]
        return self.batch.groups([f for f in found(self.batch.uri, self.batch.glob, self.batch.recursive) if after(f, start) and not after(f, end)])

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return self.batch.read(partition)

    def commit(self, end: dict) -> None:
        pass


class AnnotatedText(DataSource):
    """format("annotated_text"): options path, glob ("*.knp"), recursive and groupBytes; a schema of some of the columns reads just them."""

    @classmethod
    def name(cls) -> str:
        return "annotated_text"

    def schema(self) -> str:
        return full_schema()

    def reader(self, schema: StructType) -> AnnotatedReader:
        return AnnotatedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> AnnotatedStreamReader:
        return AnnotatedStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(AnnotatedText)
