"""Checkouts as a table of files: a data source that lists folders itself and never follows a link, and a reader of what it lists.

``spark.read.format("checkouts").option("server_depth", 1).load(path)`` after ``register(spark)`` lists files: a partition is a
server's folder, and the driver sees the servers' names alone.  A link, to a file or to a folder, is a row of its own:
nothing behind it is listed or read, wherever it leads.  ``with_content`` deals the listed files out by their names, a large
server's to many tasks, and reads them into record batches of about ``BATCH`` bytes, so that a task holds one such batch.
Paths are ``file:`` paths or plain ones, on a mount that all executors share; ``read_files`` takes other stores, which know no
links, by Spark's own reader.

Defined results: a file that can't be read, or is larger than ``most_bytes`` (0: no limit), has no content, and a size where
it is known; names that are not UTF-8 have the odd bytes replaced; an empty folder gives no rows; files outside of any
server's folder are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTED = "server_id string, path string, size long, is_symlink boolean, place binary"
FILES = "server_id string, commit_sha string, path string, content binary, size long, is_symlink boolean"
#: Bytes of contents of one record batch, and of the files that one task reads.
BATCH, TASK = 8 << 20, 64 << 20


@dataclass
class Server(InputPartition):
    name: bytes

    def __init__(self, name: bytes) -> None:
        self.name = name


def _shown(name: bytes) -> str:
    return name.decode("utf-8", "replace")


def entries_below(folder: bytes) -> Iterator[os.DirEntry]:
    """Files and links below a folder, in order of their names; links are told, not followed."""
    waiting = [folder]
    while waiting:
        with os.scandir(waiting.pop()) as found:
            inside = sorted(found, key=lambda e: e.name)
        for entry in inside:
            if entry.is_symlink() or entry.is_file(follow_symlinks=False):
                yield entry
        waiting += [e.path for e in reversed(inside) if e.is_dir(follow_symlinks=False)]


class CheckoutReader(DataSourceReader):
    def __init__(self, path: str, depth: int) -> None:
        plain = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
        self.root = os.fsencode(unquote(plain) if plain != path else path)
        self.depth = depth

    def partitions(self) -> list[InputPartition]:
        names = [b""]
        for _ in range(self.depth):
            names = [os.path.join(n, e.name) for n in names for e in sorted(os.scandir(os.path.join(self.root, n)), key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
        return [Server(n) for n in names]

    def read(self, partition: Server | None) -> Iterator[tuple]:
        if partition is None:  # there are no folders
            return
        folder = os.path.join(self.root, partition.name)
        for entry in entries_below(folder):
            try:
                size = os.stat(entry.path).st_size
            except OSError:  # a link to nowhere
                size = None
            yield _shown(partition.name), _shown(entry.path[len(folder) + 1 :]), size, entry.is_symlink(), entry.path


class CheckoutSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "checkouts"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> CheckoutReader:
        return CheckoutReader(self.options["path"], int(self.options.get("server_depth", 1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CheckoutSource)


def _content(place: bytes) -> bytes | None:
    try:
        with open(os.open(place, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:  # it may have become a link since
            return f.read()
    except OSError:
        return None


def with_content(listed: DataFrame, most_bytes: int = 0) -> DataFrame:
    """``FILES`` of ``listed``, which is read twice and so should be a written table."""
    names = [f.split()[0] for f in FILES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for server, path, size, link, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = None if link or (most_bytes and (size or 0) > most_bytes) else _content(place)
                rows.append((server, None, path, content, size, link))
                held += len(content or b"") + 200
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                    rows, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    total = listed.agg(F.sum("size")).first()[0] or 0
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    return listed.repartition(int(tasks), "server_id", "path").mapInArrow(run, FILES)
