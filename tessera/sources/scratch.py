"""Tables written once and read again: in the shared folder that the cluster names, for as long as the application lives, or
in a folder of a run's own, which another session can go on with."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Spark removes an execution's shuffle files when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. In local mode alone, where driver and executors are one, a folder of
    our own serves where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


class Scratch:
    """A folder of tables, so that a lost executor costs no recomputation and lineage stays short. Results may read them
    until the application ends; then the folder is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path, fs = self._at(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{self.base}/{name}"
        writer = df.write.mode("overwrite")
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (writer.partitionBy(*by) if by else writer).parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path, fs = self._at(f"{self.base}/{name}")
        fs.delete(path, True)


class Run(Scratch):
    """A folder of tables that outlives the application. A manifest names the tables that are whole; to write one of them
    again reads it instead, so a job that is run again from its start goes on behind the last table that it ended."""

    MANIFEST = "manifest.json"

    def __init__(self, spark: SparkSession, path: str, about: dict):
        self.spark, self.base = spark, path.rstrip("/")
        where, fs = self._at(self.base)
        fs.mkdirs(where)
        told = self._read() or {"about": about, "tables": []}
        if told["about"] != about:
            raise ValueError(f"{path} holds a run over other data or options: {told['about']}, not {about}")
        self.told = told
        self._commit()

    def _read(self) -> dict | None:
        path, fs = self._at(f"{self.base}/{self.MANIFEST}")
        if not fs.exists(path):
            # A crash between removing the old manifest and naming the new one leaves that under its other name.
            path, fs = self._at(f"{self.base}/{self.MANIFEST}.new")
            if not fs.exists(path):
                return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self) -> None:
        new, fs = self._at(f"{self.base}/{self.MANIFEST}.new")
        old, _ = self._at(f"{self.base}/{self.MANIFEST}")
        out = fs.create(new, True)
        out.write(json.dumps(self.told).encode())
        out.close()
        fs.delete(old, False)
        if not fs.rename(new, old):
            raise OSError(f"{old.toString()} could not be written")

    def has(self, name: str) -> bool:
        return name in self.told["tables"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        if not self.has(name):
            super().write(df, name, *by)
            self.told["tables"].append(name)
            self._commit()
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        """Nothing is dropped, as a later session may read it."""
