"""Tables kept together under manifests: a commit names the files of all of them at once, so that a lost job leaves the state before it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the store was read."""


class Store:
    """Named Parquet tables in one folder that driver and executors share.

    Every write goes to a new folder and counts for nothing until a manifest names it. Manifests are numbered and made
    by writing a file aside and renaming it, which happens as a whole or not at all. Readers take the newest one. A
    store has one writer at a time; a second one is refused when it commits.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), dict(schemas)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.refresh()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def refresh(self) -> None:
        """Read the newest manifest."""
        numbers = [n for n in self._names("manifests") if n.isdigit()]
        self.version = int(numbers[-1]) if numbers else 0
        self.parts = {t: [] for t in self.schemas}
        self.info: dict = {}
        if numbers:
            stream = self._fs.open(self._at(f"manifests/{numbers[-1]}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            found = json.loads(text)
            self.parts |= found["parts"]
            self.info = found["info"]

    def read(self, table: str) -> DataFrame:
        parts = [f"{self.path}/data/{p}" for p in self.parts[table]]
        return self.spark.read.schema(self.schemas[table]).parquet(*parts) if parts else self.spark.createDataFrame([], self.schemas[table])

    def write(self, table: str, rows: DataFrame) -> str:
        """A part of a table, not yet in it."""
        if rows.columns != self.spark.createDataFrame([], self.schemas[table]).columns:
            raise ValueError(f"columns {rows.columns} are not those of {table}")
        part = f"{table}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{part}")
        return part

    def commit(self, parts: Mapping[str, list[str]], info: Mapping) -> None:
        """Make these the parts of the named tables; the others keep theirs."""
        made = self.parts | {t: list(p) for t, p in parts.items()}
        aside, place = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{self.version + 1:012d}")
        self._fs.mkdirs(self._at("manifests"))
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"parts": made, "info": dict(info)}).encode()))
        finally:
            stream.close()
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            self._fs.delete(aside, False)
            raise Conflict(f"{self.path} is past version {self.version}")
        self.version, self.parts, self.info = self.version + 1, made, dict(info)

    def append(self, rows: Mapping[str, DataFrame], info: Mapping | None = None) -> None:
        """Add rows to some tables and commit once."""
        self.commit({t: [*self.parts[t], self.write(t, r)] for t, r in rows.items()}, self.info if info is None else info)

    def compact(self, files: int = 1) -> None:
        """Rewrite each table of several parts as one part of ``files`` files, and commit once; the old parts stay for readers until vacuum()."""
        self.commit({t: [self.write(t, self.read(t).coalesce(files))] for t, p in self.parts.items() if len(p) > 1}, self.info)

    def vacuum(self) -> list[str]:
        """Delete parts and manifests that the newest manifest doesn't need, such as those of lost jobs; not while others read older ones."""
        needed = {p for parts in self.parts.values() for p in parts}
        gone = [f"data/{n}" for n in self._names("data") if n not in needed] + [f"manifests/{n}" for n in self._names("manifests") if n != f"{self.version:012d}"]
        for n in gone:
            self._fs.delete(self._at(n), True)
        return gone
