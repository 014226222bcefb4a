"""Feeds of systems outside (RSS, wiki dumps, JSON lines) as a Spark data source, in batch and as a stream.

    spark.dataSource.register(FeedSource)
    spark.read.format("feed").load(folder).where("feed = 'news'")
    spark.readStream.format("feed").load(folder)

A file is a feed's portion; its name up to the first dot or dash is the feed, its ending (.rss, .wiki.xml, .jsonl) the kind. Files are
read one element at a time, so a dump of any length needs little memory, and are dealt into partitions by bytes. Equality and
lists on ``feed`` choose files before any is opened.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "feed string, item_id string, title string, link string, published string, text string, error string"
#: Which element or key of an item fills which column, by kind of file.
FIELDS = {
    "rss": {"guid": "item_id", "title": "title", "link": "link", "pubDate": "published", "description": "text"},
    "wiki": {"id": "item_id", "title": "title", "timestamp": "published", "text": "text"},
    "jsonl": {"id": "item_id", "title": "title", "url": "link", "date": "published", "text": "text"},
}
_ITEM = {"rss": "item", "wiki": "page"}
BATCH_BYTES = 4 << 20
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; anything that pyarrow reaches (file, hdfs, s3, gs)."""
    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(path).path
    return fs.FileSystem.from_uri(path)


@dataclass
class Portion(InputPartition):
    files: list[str]


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    stamp: int

    @property
    def feed(self) -> str:
        name = posixpath.basename(self.path)
        return name.split(".")[0].split("-")[0]


def kind(path: str) -> str | None:
    return "wiki" if path.endswith(".wiki.xml") else "rss" if path.endswith((".rss", ".rss.xml")) else "jsonl" if path.endswith((".jsonl", ".json")) else None


def listing(path: str) -> list[Found]:
    """Feed files under a folder, oldest first. Names and sizes only."""
    files, root = store(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((Found(f.path, f.size, int(f.mtime_ns or 0)) for f in found if f.is_file and kind(f.path)), key=lambda f: (f.stamp, f.path))


def dealt(found: list[Found], partition_bytes: int) -> list[Portion]:
    out, held, size = [], [], 0
    for f in found:
        if held and size + f.size > partition_bytes:
            out.append(Portion(held))
            held, size = [], 0
        held.append(f.path)
        size += f.size
    return [*out, Portion(held)] if held else out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(stream, of: str) -> Iterator[dict]:
    """Items of an XML file as rows; what was read is dropped at once."""
    fields, above = FIELDS[of], []
    row: dict | None = None
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        name = _local(element.tag)
        if event == "start":
            above.append(element)
            if name == _ITEM[of]:
                row = {}
            continue
        above.pop()
        if row is not None and name in fields and fields[name] not in row:  # the first of a name: a page's id, not its revision's
            row[fields[name]] = element.text
        if name == _ITEM[of] and row is not None:
            yield row
            row = None
        if row is None and above:
            above[-1].remove(element)


def items(path: str, root: str) -> Iterator[tuple]:
    """Rows of one file. What breaks off in the middle gives the items before, then one row with the error; a line of JSON that
    isn't an object gives a row with the error in its place."""
    files, _ = store(root)
    feed, of = Found(path, 0, 0).feed, kind(path)
    as_row = lambda r, error=None: (feed, *[None if r.get(c) is None else str(r[c]) for c in _COLUMNS[1:-1]], error)
    with files.open_input_stream(path) as stream:
        if of == "jsonl":
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from (_line(x, as_row) for x in lines if x.strip())
            if rest.strip():
                yield _line(rest, as_row)
            return
        try:
            for row in _elements(stream, of):
                yield as_row(row)
        except ElementTree.ParseError as e:
            yield as_row({}, str(e))


def _line(line: bytes, as_row) -> tuple:
    try:
        found = json.loads(line)
        return as_row({c: found.get(k) for k, c in FIELDS["jsonl"].items()}) if isinstance(found, dict) else as_row({}, "not an object")
    except ValueError as e:
        return as_row({}, str(e))


def batches(rows: Iterator[tuple], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in batches of up to ``most`` letters, and one row more: what a task holds doesn't grow with its rows or their texts."""
    held, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=_COLUMNS)
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if x)
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("partitionbytes", 128 << 20))
        self.feeds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            chosen = {f.value} if isinstance(f, EqualTo) and f.attribute == ("feed",) else set(f.value) if isinstance(f, In) and f.attribute == ("feed",) else None
            if chosen is None:
                yield f
            else:
                self.feeds = chosen if self.feeds is None else self.feeds & chosen

    def partitions(self) -> list[Portion]:
        return dealt([f for f in listing(self.path) if self.feeds is None or f.feed in self.feeds], self.bytes) or [Portion([])]

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        return batches(row for f in partition.files for row in items(f, self.path))


class FeedStream(DataSourceStreamReader):
    """New files by time of change and name; a file counts once it is whole (write it beside and move it in)."""

    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("partitionbytes", 128 << 20))

    def initialOffset(self) -> dict:
        return {"stamp": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = listing(self.path)
        return {"stamp": found[-1].stamp, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Portion]:
        place = lambda o: (o["stamp"], o["path"])
        return dealt([f for f in listing(self.path) if place(start) < (f.stamp, f.path) <= place(end)], self.bytes)

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        return batches(row for f in partition.files for row in items(f, self.path))

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Options: ``path`` (a folder), ``partitionBytes`` (128 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make ``feed`` known to the session, with conditions handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
    return spark
