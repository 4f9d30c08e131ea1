"""Numbered manifests: what a table consists of, switched in one step once all its files are there."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Manifests that stay for readers that have begun with one.
KEPT = 8
#: Rows of a kept table up to which it may be broadcast.
BROADCAST = 250_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a local one only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: lineage is cut, and what is read again isn't worked out again.

    Encoded files say little about how large rows are in the driver's memory, so joins right above a table of many rows are told not to broadcast.
    """
    path, wrote = scratch(df.sparkSession, name), Observation()
    df.observe(wrote, F.count("*").alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out = out if wrote.get["n"] <= BROADCAST else out.hint("merge")
    out._folder = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``kept`` that nothing reads any more."""
    for x in tables:
        path = x.sparkSession._jvm.org.apache.hadoop.fs.Path(x._folder)
        path.getFileSystem(x.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Versions:
    """Manifests ``m0000000001.json``, ... in a folder; the highest is current.

    A manifest is written aside and renamed, so that none is seen in part; of two writers that began with the same version the later fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _store(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, *below: str) -> list[str]:
        """Of what lies in the folder, or in one below it."""
        path, store = self._path(*below), self._store()
        return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []

    def remove(self, *below: str) -> None:
        self._store().delete(self._path(*below), True)

    def _numbers(self) -> list[int]:
        return [int(n[1:11]) for n in self.names("manifests") if n.startswith("m") and n.endswith(".json")]

    def current(self) -> tuple[int, dict]:
        """The highest version and its manifest; 0 and an empty one before the first commit."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._store().open(self._path("manifests", f"m{max(numbers):010}.json"))
        try:
            return max(numbers), json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, manifest: dict) -> int:
        """Makes ``manifest`` the one after ``version``."""
        store, aside, to = self._store(), self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"m{version + 1:010}.json")
        stream = store.create(aside)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if store.exists(to) or not store.rename(aside, to):
            store.delete(aside, False)
            raise RuntimeError(f"another writer has committed version {version + 1} of {self.folder}")
        for n in sorted(self._numbers())[:-KEPT]:
            self.remove("manifests", f"m{n:010}.json")
        return version + 1
