"""File trees on any file system that Arrow opens (local, HDFS, object stores), listed and read by tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders the driver looks into, at most, to deal a tree out; what lies below is listed by tasks.
DEALT = 128
#: Names or bytes of a batch.
NAMES, BYTES = 10_000, 16 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def is_folder(path: str) -> bool:
    system, at = opened(path)
    return system.get_file_info(at).type == fs.FileType.Directory


def is_link(system: fs.FileSystem, path: str) -> bool:
    return isinstance(system, fs.LocalFileSystem) and os.path.islink(path)


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    """Rows (rel, size) of the regular files whose name ends with ``suffix``, hidden folders included, links not followed."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def _look(self, system: fs.FileSystem, folder: str) -> tuple[list[fs.FileInfo], list[str]]:
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        kept = [x for x in found if not is_link(system, x.path)]
        return [x for x in kept if x.type == fs.FileType.File], sorted(x.path for x in kept if x.type == fs.FileType.Directory)

    def partitions(self) -> list[InputPartition]:
        """Breadth first: a folder that was looked into is one part without its folders, any other one with all below."""
        system, root = opened(self.path)
        waiting, parts = [root], []
        while waiting and len(parts) + len(waiting) < DEALT:
            folder = waiting.pop(0)
            parts.append(Part(folder, False))
            waiting += self._look(system, folder)[1]
        return [*parts, *[Part(f, True) for f in waiting]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        waiting, names, sizes = [partition.folder], [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["rel", "size"])

        while waiting:
            files, folders = self._look(system, waiting.pop())
            if partition.deep:
                waiting += folders
            for x in files:
                if x.base_name.endswith(self.suffix):
                    names.append(x.path[len(root.rstrip("/")) + 1 :])
                    sizes.append(x.size)
                if len(names) >= NAMES:
                    yield batch()
                    names, sizes = [], []
        yield batch()


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_tree"

    def schema(self) -> str:
        return "rel string, size long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def list_tree(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """``rel, size`` of the files below ``root``; no list of them passes the driver."""
    spark.dataSource.register(Tree)
    return spark.read.format("tessera_tree").option("path", root).option("suffix", suffix).load()


def read_files(listed: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """``rel, content`` of ``listed`` (rel), dealt evenly over tasks; a file that is gone meanwhile is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(root)
        names, texts, held = [], [], 0
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{at.rstrip('/')}/{rel}") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except FileNotFoundError:
                    continue
                names.append(rel)
                held += len(texts[-1])
                if held > BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["rel", "content"])
                    names, texts, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["rel", "content"])

    tasks = tasks or 2 * listed.sparkSession.sparkContext.defaultParallelism
    return listed.select("rel").repartition(tasks).mapInArrow(run, "rel string, content string")
