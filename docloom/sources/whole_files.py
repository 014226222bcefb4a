"""Whole files of one folder as a Spark data source: a row a file, many small files a task.

    spark.dataSource.register(WholeFiles)
    spark.read.format("whole_files").option("pattern", "*.json").load(folder)

The folder is listed once. Spark's own readers list every file that a glob matches as a path of its own, and count each file as 4 MiB, so
a task holds 32 of them; here files are dealt into partitions by their bytes and a little for opening each. Batches are bounded in bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.sources.feeds import store

OPEN_BYTES = 4 << 10  # what opening a file counts
BATCH_BYTES = 8 << 20


@dataclass
class Names(InputPartition):
    names: str  # joined by slashes, which no name holds
    sizes: list[int]


def reached(glob: str) -> tuple[str, str] | None:
    """Folder and pattern of a glob that this source can read: a pattern in the last part only, of * and ?, on the local or a mounted file system."""
    folder, _, pattern = glob.rpartition("/")
    if not folder or not pattern or re.search(r"[*?\[{\\]", folder) or re.search(r"[\[\]{}\\]", pattern) or urlsplit(glob).scheme not in ("", "file"):
        return None
    if not urlsplit(glob).scheme and not os.path.isdir(folder):  # of the cluster's own file system
        return None
    return folder, pattern


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.bytes, self.content = int(options.get("partitionbytes", 32 << 20)), options.get("content", "true") == "true"

    def partitions(self) -> list[Names]:
        files, root = store(self.path)
        out, names, sizes, held = [], [], [], 0
        for f in files.get_file_info(fs.FileSelector(root)):
            if not f.is_file or f.base_name.startswith(("_", ".")) or not fnmatchcase(f.base_name, self.pattern):
                continue
            size = (f.size if self.content else 0) + OPEN_BYTES
            if names and held + size > self.bytes:
                out.append(Names("/".join(names), sizes))
                names, sizes, held = [], [], 0
            names.append(f.base_name)
            sizes.append(f.size)
            held += size
        return [*out, Names("/".join(names), sizes)]

    def read(self, partition: Names) -> Iterator[pa.RecordBatch]:
        files, root = store(self.path)
        root = root.rstrip("/")
        names, paths, sizes, contents, held = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((names, paths, sizes, contents), kinds, strict=True)], names=["name", "path", "length", "content"])

        for name, size in zip(filter(None, partition.names.split("/")), partition.sizes, strict=True):
            if names and (held + size > BATCH_BYTES or len(names) == 10_000):
                yield batch()
                names, paths, sizes, contents, held = [], [], [], [], 0
            content = None
            if self.content:
                with files.open_input_stream(f"{root}/{name}") as stream:
                    content = stream.read()
            names.append(name)
            paths.append(f"file:{_quoted(f'{root}/{name}')}")
            sizes.append(size)
            contents.append(content)
            held += size if self.content else 0
        if names:
            yield batch()


def _quoted(path: str) -> str:
    """As Spark writes the path of a file: letters beyond ASCII stay."""
    return re.sub(r"[\x00-\x7f]+", lambda m: quote(m[0], safe="/!~'()*,;:$&+=@"), path)


class WholeFiles(DataSource):
    """Options: ``path`` (a folder), ``pattern`` (of names; those with _ or . in front are left out), ``partitionBytes`` (32 MiB),
    ``content`` (false: names and lengths only)."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, path string, length long, content binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WholeFiles)
    return spark
