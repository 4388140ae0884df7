"""A folder of folders, one a law, as a data source: spark.read.format("law_folders").load(path).

The reader plans a partition a folder, in the order of their names. Predicates on law or folder choose among the folders before any is
opened; the option `limit` then takes the first so many, and `pattern` names the files. A folder without such a file is a row with null
name and content, so that it can be reported as skipped.

rows(folder, name, content).write.format("law_folders").mode("append").save(path) writes one: a folder a row, with its file, or with none if the name
is null. Each task writes its rows' folders where they belong, so no driver moves them one by one; a task that runs again writes the same.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage


def law_of(folder: str) -> str:
    """The law's number: the first underscore stands for a slash."""
    return folder.replace("_", "/", 1)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(path: str) -> Iterator[str]:
    """The folders in a folder, in no order; local ones as the system lists them, without asking about each."""
    from pyarrow import fs

    system, root = _system(path)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(root) as found:
            yield from (x.name for x in found if x.is_dir())
    else:
        yield from (x.base_name for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory)


@dataclass
class Folder(InputPartition):
    name: str


class FolderReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, limit: int | None) -> None:
        self.path, self.pattern, self.limit = path, pattern, limit
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and IN on the folder's name or law; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in ("law", "folder"):
                self.wanted.append((column, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> list[Folder]:
        chosen = (n for n in _names(self.path) if all((law_of(n) if column == "law" else n) in values for column, values in self.wanted))
        return [Folder(n) for n in (sorted(chosen) if self.limit is None else heapq.nsmallest(self.limit, chosen))]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # no folder was chosen
            return
        system, root = _system(self.path)
        files = system.get_file_info(fs.FileSelector(f"{root}/{partition.name}"))
        found = sorted((x for x in files if x.type == fs.FileType.File and fnmatch(x.base_name, self.pattern)), key=lambda x: x.base_name)
        for x in found:
            with system.open_input_stream(x.path) as stream:
                yield partition.name, law_of(partition.name), x.base_name, x.size, stream.read()
        if not found:
            yield partition.name, law_of(partition.name), None, None, None


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns
        if set(columns) != {"folder", "name", "content"}:
            raise ValueError(f"a folder, the name of its file and the content are written, not {columns}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _system(self.path)
        for batch in iterator:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                folder = f"{root}/{row['folder']}"
                system.create_dir(folder, recursive=True)
                if row["name"] is not None:  # whole under its name, or not there
                    with system.open_output_stream(held := f"{folder}/.{uuid.uuid4().hex}") as stream:
                        stream.write(row["content"] or b"")
                    system.move(held, f"{folder}/{row['name']}")
        return WriterCommitMessage()


class LawFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "law_folders"

    def schema(self) -> str:
        return "folder string, law string, name string, bytes long, content binary"

    def reader(self, schema) -> FolderReader:
        limit = self.options.get("limit")
        return FolderReader(self.options["path"].rstrip("/"), self.options.get("pattern", "*"), None if limit is None else int(limit))

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("folders are only added: mode('append')")
        return FolderWriter(self.options["path"].rstrip("/"), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LawFolders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
