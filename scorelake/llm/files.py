"""Files that tasks write and read themselves, in the shared folder of ``spark.checkpoint.dir``.

Paths are URIs; local and network mounts (``file:``) and every store that pyarrow opens (hdfs, s3,
gs) work from any executor."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


class Pending:
    """A file under its attempt's name until it is complete."""

    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.fs, self.folder = fs, folder
        self.path = f"{folder}/_pending-{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.path)
        self.write = self.out.write

    def commit(self, name: str) -> None:
        self.out.close()
        self.fs.move(self.path, f"{self.folder}/{name}")


class Store:
    def __init__(self, folder: str):
        self.fs, self.folder = resolve(folder)
        self.fs.create_dir(self.folder, recursive=True)

    def create(self) -> Pending:
        return Pending(self.fs, self.folder)


def opened(uri: str) -> tuple[Callable[[int, int], bytes], int]:
    """A function that reads (offset, length), and the file's size."""
    fs, path = resolve(uri)
    file = fs.open_input_file(path)
    return lambda at, n: file.read_at(n, at), file.size()


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of the folder's files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("path"), F.col("length"))
