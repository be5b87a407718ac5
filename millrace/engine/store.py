"""Versioned tables in a folder: data in immutable Parquet folders, and a log of numbered commits that name the current ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.errors import CONFLICT, SqlError


@dataclass
class Meta:
    """A table: its schema (JSON), its data folders or files, and its constraints."""

    schema: str
    parts: list[str] = field(default_factory=list)
    key: str | None = None
    unique: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class Store:
    """Files below a root, on any file system that Spark reads.

    A commit is one file, ``_log/<number>.json``, with all tables of that version: several tables change together or not
    at all. It is created only if its number is free, so of two writers that began with one version the second one sees
    the first, and fails if both changed one table. A file that a crash has cut short is passed over. Data of old
    versions stays, for readers that began with them, until ``vacuum``.
    """

    #: Versions whose commit files stay.
    KEPT = 20

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        # With its scheme, as Spark names the files below it.
        self.root = self._fs.makeQualified(self._path(root)).toString().rstrip("/")
        self.version, self._seen, self._tables = 0, -1, {}
        self.refresh()

    def _numbers(self) -> list[int]:
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def refresh(self) -> dict[str, Meta]:
        """The tables of the newest whole commit."""
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        if last != self._seen:
            self.version, self._tables = 0, {}
            for n in reversed(numbers):
                stream = self._fs.open(self._path(f"{self.root}/_log/{n:012d}.json"))
                try:
                    tables = json.loads(bytes(stream.readAllBytes()).decode())
                except ValueError:
                    continue  # cut short by a crash, or being written
                finally:
                    stream.close()
                self.version, self._tables = n, {k: Meta(**v) for k, v in tables.items()}
                break
            self._seen = last if self.version == last else -1
        return dict(self._tables)

    def commit(self, base: dict[str, Meta], changes: dict[str, Meta | None]) -> dict[str, Meta]:
        """Makes changes (None: the table goes) to tables that were as in base; the tables after that."""
        while True:
            now, numbers = self.refresh(), self._numbers()
            for name in changes:
                if now.get(name) != base.get(name):
                    raise SqlError(f"table {name} was changed by another session", CONFLICT)
            after = {k: v for k, v in (now | changes).items() if v is not None}
            number = (numbers[-1] if numbers else 0) + 1
            try:
                stream = self._fs.create(self._path(f"{self.root}/_log/{number:012d}.json"), False)
            except Exception as e:
                if number in self._numbers():
                    continue  # another session was first: look again
                raise SqlError(f"the commit can't be written: {e}", CONFLICT) from e
            stream.write(bytearray(json.dumps({k: asdict(v) for k, v in after.items()}).encode()))
            stream.close()
            for n in numbers[: -self.KEPT]:
                self._fs.delete(self._path(f"{self.root}/_log/{n:012d}.json"), False)
            return self.refresh()

    def vacuum(self) -> int:
        """Deletes data that no kept version of any table names; the number of folders deleted. Not beside open readers."""
        named = "\n".join(p for meta in self.refresh().values() for p in meta.parts)
        gone = 0
        for table in self._fs.listStatus(self._path(self.root)) if self._fs.exists(self._path(self.root)) else []:
            if table.isDirectory() and not table.getPath().getName().startswith("_"):
                for part in self._fs.listStatus(table.getPath()):
                    name = part.getPath().getName()
                    if name.startswith("data-") and name not in named:
                        gone += bool(self._fs.delete(part.getPath(), True))
        return gone

    def write(self, name: str, df: DataFrame) -> str:
        """Writes rows to a new data folder of the table."""
        path = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def read(self, meta: Meta) -> DataFrame:
        if not meta.parts:
            return self.spark.createDataFrame([], meta.struct)
        return self.spark.read.schema(meta.struct).parquet(*meta.parts)

    def matching(self, meta: Meta, condition) -> tuple[int, list[str], list[str]]:
        """(rows that fulfil condition, files that hold any, all other files), in one pass; a row a file to the driver."""
        if not meta.parts:
            return 0, [], []
        df = self.read(meta)
        found = df.filter(condition).groupBy(F.col("_metadata.file_path").alias("path")).count().collect()
        place: Callable[[str], str] = lambda p: unquote(p).replace("file:///", "file:/")
        hit = {place(r["path"]) for r in found}
        return sum(r["count"] for r in found), sorted(hit), sorted({place(p) for p in df.inputFiles()} - hit)
