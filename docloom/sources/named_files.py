"""A sink that writes one file a row under the row's own name, from tasks, without a rename on the driver.

    spark.dataSource.register(NamedFiles)
    docs.select("id", "raw").write.format("named_files").mode("append").option("suffix", ".json").save(folder)

A task writes into a folder of its own attempt and moves its files to their names once all are whole; an attempt that fails removes its
folder and leaves nothing. The driver gets counts and the name of a list of the files that a task has moved; if the job fails, what
other tasks have moved is taken away by those lists (files of these names from before are gone, too). A task that runs again
writes the same names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docloom.sources.feeds import store


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int
    names: str  # a file with the names


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.suffix, self.pretty = options["path"], options.get("suffix", ""), options.get("pretty", "false") == "true"
        self.job = uuid.uuid4().hex
        if "/" in self.suffix:
            raise ValueError("a suffix has no slash")
        files, _, work = self._folder()
        files.create_dir(work, recursive=True)  # by the driver only: a task that starts after an abort finds no folder

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        files, root = store(self.path)
        return files, root.rstrip("/"), f"{root.rstrip('/')}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root, work = self._folder()
        attempt, names, size = f"{work}/{uuid.uuid4().hex}", [], 0
        files.create_dir(attempt, recursive=False)
        try:
            rows = ((n.as_py(), t) for b in iterator for n, t in zip(b.column(0), b.column(1), strict=True))
            for own, value in rows:  # one text of a batch at a time becomes an object
                name, text = f"{own}{self.suffix}", value.as_py() or ""
                if own is None or not own or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"no name for a file: {own!r}")
                data = (json.dumps(json.loads(text), indent=2, ensure_ascii=False) if self.pretty else text).encode()
                with files.open_output_stream(f"{attempt}/{name}") as out:
                    out.write(data)
                names.append(name)
                size += len(data)
            moved = f"{attempt}.names"
            with files.open_output_stream(moved) as out:  # before the first move: an abort finds all of them
                out.write("\n".join(names).encode())
            for name in names:
                files.move(f"{attempt}/{name}", f"{root}/{name}")
        finally:
            if files.get_file_info(attempt).type == fs.FileType.Directory:
                files.delete_dir(attempt)
        return Written(len(names), size, moved)

    def commit(self, messages: list[Written | None]) -> None:
        files, _, work = self._folder()
        files.delete_dir(work)

    def abort(self, messages: list[Written | None]) -> None:
        """Every list in the job's folder counts, also of tasks whose message got lost. The folder gets another name first: tasks
        that still run can move nothing from then on, and what they moved before is listed."""
        files, root, work = self._folder()
        gone = f"{work}-aborted"
        if files.get_file_info(work).type != fs.FileType.Directory:
            return
        files.move(work, gone)
        for found in files.get_file_info(fs.FileSelector(gone)):
            if found.path.endswith(".names"):
                with files.open_input_stream(found.path) as stream:
                    for name in filter(None, stream.read().decode().split("\n")):
                        if files.get_file_info(f"{root}/{name}").is_file:
                            files.delete_file(f"{root}/{name}")
        files.delete_dir(gone)


class NamedFiles(DataSource):
    """Rows (name, text). Options: ``path``, ``suffix``, ``pretty`` (texts are JSON, written with an indent of 2, keys in their order)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files are added; choose a new folder")
        return Writer(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NamedFiles)
    return spark
