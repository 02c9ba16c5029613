"""SARIF documents as files: a data source that writes one file per server and part, all of them or none.

``documents.write.format("sarif").mode(..).save(path)`` after ``register(spark)``; ``spark.read.format("sarif").load(path)`` reads
them back.  Tasks write below a staging folder of the job; the commit moves the folders of those tasks whose result counts to
their place, marks the whole with ``_SUCCESS`` and removes the staging folder, what failed or doubled attempts left with it.
An aborted job removes the staging folder and leaves what was there before.  Paths are those that pyarrow opens (file, s3,
gs, hdfs), and must be shared by all executors.

Defined results: rows without a server or a document stop the write; a server's name may be of any length and hold any
character; an empty table gives a folder with ``_SUCCESS`` alone; ``overwrite`` replaces all that was there, at the commit.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "server_id string, part long, document string"
ENDING = ".sarif.json"
#: Characters of one level of a file's path, below what file systems allow.
LEVEL = 180


def _file_of(server: str, part: int) -> str:
    """The quoted name in levels, then the part; dots are quoted too, so that no level is a step up."""
    said = quote(server, safe="").replace(".", "%2E") or "%"
    return "/".join([said[i : i + LEVEL] for i in range(0, len(said), LEVEL)]) + f".{part}{ENDING}"


def _server_of(name: str) -> tuple[str, int]:
    said, part = name.removesuffix(ENDING).rsplit(".", 1)
    said = said.replace("/", "")
    return "" if said == "%" else unquote(said), int(part)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder within the staging folder."""

    folder: str


class SarifWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        files, _, staging = self._staging()
        files.create_dir(staging, recursive=True)  # here alone: a task that outlives an abort finds no place to write to

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        files, root = pafs.FileSystem.from_uri(self.path)
        return files, root, f"{root}/_staging-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        files, _, staging = self._staging()
        folder, made = uuid.uuid4().hex, set()
        for row in rows:
            if row["server_id"] is None or row["document"] is None:
                raise ValueError("a document or its server is missing")
            levels = f"{folder}/{_file_of(row['server_id'], row['part'])}".split("/")
            for level in ("/".join(levels[:i]) for i in range(1, len(levels))):
                if level not in made:
                    files.create_dir(f"{staging}/{level}", recursive=False)
                    made.add(level)
            with files.open_output_stream("/".join([staging, *levels])) as out:
                out.write(row["document"].encode())
        return Written(folder)

    def commit(self, messages: list) -> None:
        files, root, staging = self._staging()
        before = [f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.path.rsplit("/", 1)[-1] != staging.rsplit("/", 1)[-1]]
        there = {f.base_name for f in files.get_file_info(pafs.FileSelector(staging))}
        for message in messages:
            if message is not None and message.folder in there:  # tasks without rows made none
                files.move(f"{staging}/{message.folder}", f"{root}/{message.folder}")
        for old in before if self.overwrite else []:
            (files.delete_dir if files.get_file_info(old).type == pafs.FileType.Directory else files.delete_file)(old)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass
        files.delete_dir(staging)

    def abort(self, messages: list) -> None:
        files, _, staging = self._staging()
        for again in range(20):  # tasks that are still being stopped may add a file meanwhile
            try:
                if files.get_file_info(staging).type == pafs.FileType.Directory:
                    files.delete_dir(staging)
                return
            except OSError:
                time.sleep(0.05 * again)


@dataclass
class Folder(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class SarifReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        files, root = pafs.FileSystem.from_uri(self.path)
        return [Folder(f.path) for f in files.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory and not f.base_name.startswith("_")]

    def read(self, partition: Folder | None) -> Iterator[tuple[str, int, str]]:
        if partition is None:  # there are no folders
            return
        files, _ = pafs.FileSystem.from_uri(self.path)
        for f in files.get_file_info(pafs.FileSelector(partition.path, recursive=True)):
            if f.type == pafs.FileType.File and f.path.endswith(ENDING):
                with files.open_input_stream(f.path) as said:
                    yield (*_server_of(f.path.removeprefix(partition.path).lstrip("/")), said.read().decode())


class SarifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sarif"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SarifReader:
        return SarifReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SarifWriter:
        return SarifWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SarifSource)
