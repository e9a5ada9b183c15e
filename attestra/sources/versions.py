"""Tables that change by whole versions: data is staged, and one small manifest makes it count.

A folder holds ``data``, in which every write has a folder of its own, and ``versions``, numbered manifests that name the folders of each table.
Readers take the highest manifest and the folders that it names, so they see all of a commit or nothing. A commit creates the next number and fails
if it exists, so of two writers one wins; the other reads again and repeats its commit, or gives up where its data rests on the older version. What a
lost writer has staged is named by no manifest. A batch carries a name, and a name that is committed is not written again.

The number is created by renaming a finished file, which file systems with an atomic rename (HDFS among them) let only one writer do.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Somebody else has committed the version that this commit would have made."""


class Manifests:
    """Numbered JSON documents in a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._bytes = jvm.org.apache.hadoop.io.IOUtils
        self.folder = self._fs.makeQualified(self._path(folder)).toString()

    def latest(self) -> tuple[int, dict]:
        """(number, document) of the last commit; (0, {}) before the first."""
        here = self._path(self.folder)
        if not self._fs.exists(here):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(here)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return (max(numbers), self.at(max(numbers))) if numbers else (0, {})

    def at(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{number:012}.json"))
        try:
            return json.loads(bytes(self._bytes.readFullyToByteArray(stream)))
        finally:
            stream.close()

    def commit(self, number: int, document: dict) -> None:
        """Make ``document`` version ``number``, or raise Conflict if there is one already."""
        staged, made = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{number:012}.json")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        stream.close()
        try:
            self._context.rename(staged, made, self._none)
        except Py4JJavaError as error:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {number} exists") from error
            raise


class VersionedTables:
    """Several tables under one folder that are committed together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifests = Manifests(spark, f"{self.folder}/versions")

    def version(self) -> int:
        return self.manifests.latest()[0]

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._document(version).get("tables", {}))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the last one by default. The folders are fixed now, so what is committed later does not show."""
        held = self._document(version).get("tables", {}).get(table)
        if held is None:
            raise KeyError(f"no table {table!r} in {self.folder}")
        frame = self.spark.read.schema(held["schema"])
        return frame.parquet(*[f"{self.folder}/data/{f}" for f in held["folders"]]) if held["folders"] else self.spark.createDataFrame([], held["schema"])

    def batches(self) -> list[str]:
        return sorted(self.manifests.latest()[1].get("batches", []))

    def append(self, rows: dict[str, DataFrame], batch: str, tries: int = 20) -> bool:
        """Add rows to tables in one commit; False if the batch is committed already."""
        if batch in self.manifests.latest()[1].get("batches", []):
            return False
        staged = self._stage(rows)
        for _ in range(tries):
            number, now = self.manifests.latest()
            if batch in now.get("batches", []):
                return False
            tables = dict(now.get("tables", {}))
            for name, (folder, schema) in staged.items():
                held = tables.get(name, {"schema": schema, "folders": []})
                if held["schema"] != schema:
                    raise ValueError(f"{name} has other columns: {held['schema']}")
                tables[name] = {"schema": schema, "folders": [*held["folders"], folder]}
            try:
                self.manifests.commit(number + 1, {"tables": tables, "batches": [*now.get("batches", []), batch]})
                return True
            except Conflict:
                continue
        raise Conflict(f"{tries} commits came first")

    def replace(self, rows: dict[str, DataFrame], based_on: int, batch: str | None = None) -> int:
        """Give tables new contents that were made from version ``based_on``; Conflict if that is not the last one any more. Other tables stay."""
        number, now = self.manifests.latest()
        if number != based_on:
            raise Conflict(f"version {number} came after {based_on}")
        if batch is not None and batch in now.get("batches", []):
            return number
        staged = self._stage(rows)
        tables = {**now.get("tables", {}), **{name: {"schema": schema, "folders": [folder]} for name, (folder, schema) in staged.items()}}
        self.manifests.commit(based_on + 1, {"tables": tables, "batches": [*now.get("batches", []), *([batch] if batch else [])]})
        return based_on + 1

    def _document(self, version: int | None) -> dict:
        return self.manifests.latest()[1] if version is None else self.manifests.at(version)

    def _stage(self, rows: dict[str, DataFrame]) -> dict[str, tuple[str, str]]:
        staged = {}
        for name, frame in rows.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            frame.write.parquet(f"{self.folder}/data/{folder}")
            staged[name] = folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        return staged


def finalize(store: VersionedTables, dataset_id: str, dataset: DataFrame, records: DataFrame, sources: DataFrame) -> bool:
    """A run's dataset, records and sources in one commit: all three can be read afterwards or none. A dataset is finalised once."""
    return store.append({"datasets": dataset, "dataset_records": records, "dataset_sources": sources}, f"dataset-{dataset_id}")
