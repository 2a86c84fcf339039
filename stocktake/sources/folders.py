"""Folders as a data source: spark.read.format("folders").option("root", ...).load()."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stocktake.functions.ignore import matcher

from .files import SCANNED, _entries, _store


@dataclass
class Folder(InputPartition):
    """Folders whose entries are listed; deep: with all that is below them."""

    paths: tuple[str, ...]
    deep: bool


class FolderSource(DataSource):
    """The entries below a root, as files.scan_with_warnings has them, in one job.

    Options: root; ignore, rules one on a line; prefixes, paths one on a line, of which and below which entries are wanted: other
    folders are not opened; partitions (64), the number of folders that the driver looks for from the root down, level by level, so that each is one task
    with all that is below it. The driver lists no more than one level beyond that. Where one folder holds nearly everything several levels down,
    scan_with_warnings, which deals every level anew, is the better choice.
    """

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCANNED

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("root"):
            raise ValueError("the option root is missing")
        self.root = options["root"]
        self.rules = [x for x in options.get("ignore", "").split("\n") if x]
        self.prefixes = [x.strip("/") for x in options.get("prefixes", "").split("\n") if x.strip("/")]
        self.wanted = int(options.get("partitions", 64))

    def _inside(self, path: str) -> bool:
        """The path is wanted itself."""
        return not self.prefixes or any(path == p or path.startswith(f"{p}/") for p in self.prefixes)

    def _leads(self, path: str) -> bool:
        """Something below the folder is wanted."""
        return path == "" or self._inside(path) or any(p.startswith(f"{path}/") for p in self.prefixes)

    def _listed(self, store, base: str, folder: str, ignores) -> Iterator[tuple[tuple, bool]]:
        """Rows of a folder, and whether each is a folder to go on with. Warnings are never left out."""
        for row in _entries(store, base, folder):
            is_folder = row[1] == "dir"
            if row[5] is None and (ignores(row[0], is_folder) or not (self._leads(row[0]) if is_folder else self._inside(row[0]))):
                continue
            yield row, is_folder

    def partitions(self) -> list[InputPartition]:
        store, base = _store(self.root)
        ignores, level, shallow = matcher(self.rules), [""], []
        while level and len(level) < self.wanted:
            below = []
            for folder in level:
                for row, is_folder in self._listed(store, base, folder, ignores):
                    if row[0] == "":
                        raise OSError(f"{self.root}: {row[5]}")
                    if is_folder:
                        below.append(row[0])
            shallow += level
            level = below
        return ([Folder(tuple(shallow), False)] if shallow else []) + [Folder((x,), True) for x in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        store, base = _store(self.root)
        ignores, waiting = matcher(self.rules), deque(partition.paths)
        while waiting:
            for row, is_folder in self._listed(store, base, waiting.popleft(), ignores):
                if row[5] is not None or self._inside(row[0]):
                    yield row
                if is_folder and partition.deep:
                    waiting.append(row[0])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
