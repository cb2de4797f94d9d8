"""Extension: what each version of a file adds, changes and removes, function by function.

The state is kept by path, in the stream's checkpoint: the last version's number, and of each of its functions the hash of the
body and where it is. A new version is read once and compared with that, so a stream that is started again goes on from
what it knew, and a body that comes back after any time is told as what it is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.extract import read_text

SCHEMA = "path string, version long, unique_fqn string, change string, old_hash string, new_hash string, start_line int, end_line int"
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: What of a function is compared and told.
_TOLD = frozenset({"unique_fqn", "function_hash", "start_line", "end_line"})


class _Versions(StatefulProcessor):
    """Each path's functions. Of equal ids the last in the file counts. What is known of a path is one value, as each call of
    the store is a message to the JVM."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "version long, ids array<string>, hashes array<string>, first array<int>, last array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, old = None, {}
        if self.known.exists():
            known, ids, *columns = self.known.get()
            old = dict(zip(ids, zip(*columns)))
        before = known
        # Versions that a micro-batch holds together come in their order; one that is not newer than what is known is late.
        for version, text in sorted({(r.version, r.text) for r in rows}, key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            if known is not None and version <= known:
                continue
            new = {f["unique_fqn"]: (f["function_hash"], f["start_line"], f["end_line"]) for f in read_text(text, None, {"functions"}, _TOLD)["functions"]}
            yield from self.step(key[0], version, old, new)
            known, old = version, new
        if known != before:
            hashes, first, last = map(list, zip(*old.values())) if old else ([], [], [])
            self.known.update((known, list(old), hashes, first, last))

    def step(self, path: str, version: int, old: dict[str, tuple], new: dict[str, tuple]) -> Iterator[Row]:
        for name in sorted(old.keys() - new.keys()):
            digest, first, last = old[name]
            yield Row(path=path, version=version, unique_fqn=name, change="removed", old_hash=digest, new_hash=None, start_line=first, end_line=last)
        for name, (digest, first, last) in new.items():
            before = old[name][0] if name in old else None
            if before != digest:
                yield Row(path=path, version=version, unique_fqn=name, change="added" if before is None else "changed", old_hash=before, new_hash=digest, start_line=first, end_line=last)

    def close(self) -> None:
        pass


def stream_snapshots(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, version, text) of snapshots below a root: <root>/<version>/<path>, with versions by number. A file
    without a byte has no row."""
    s = spark.readStream.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    # The path as it is, not as in an address, and what of it is below the root.
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    below = rf"^.*?\Q/{root.rstrip('/').split('://')[-1].strip('/')}/\E(\d+)/(.+)$"
    return s.select(F.regexp_extract(path, below, 2).alias("path"), F.regexp_extract(path, below, 1).try_cast("long").alias("version"), F.col("value").alias("text"))


def function_changes(versions: DataFrame) -> DataFrame:
    """path, version, unique_fqn, change (added, changed, removed), old_hash, new_hash, start_line, end_line, of a stream of
    (path, version, text). A null text is a file that is gone. Needs the state store that write_changes sets."""
    v = versions.select("path", F.col("version").cast("long").alias("version"), "text").where("path is not null and version is not null")
    return v.groupBy("path").transformWithState(_Versions(), SCHEMA, "append", "none")


def write_changes(versions: DataFrame, target: str, checkpoint: str):
    """Starts a query that appends to a Parquet table what the versions that are there change, and then ends. Started
    again with the same checkpoint, it goes on with those that are new."""
    spark = versions.sparkSession
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        return function_changes(versions).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
