"""What models have answered, kept in a written table, so that a run that is started again, in any session, and a lost
executor pay for no answer twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

#: Prompts of a wave to a file that it is read from.
FILE = 50_000
SCHEMA = "key string, answer string, run string, asked_at timestamp"


def prompt_key(role: str, *columns: str):
    """The hash of a role and of what it is asked; null counts as an empty text."""
    return F.sha2(F.to_json(F.struct(F.lit(role).alias("role"), *[F.coalesce(c, F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)])), 256)


class Answers:
    """A folder of answers by the key of their prompt.

    What is asked is told from what is known by one anti-join before any call, and written by wave. Calls go out in waves of about `wave` prompts,
    each committed as a whole before the next, so a failure costs what one wave had not yet committed; a task asks `batch`
    prompts at most, so a lost executor costs no more than its running tasks. An answer that is null is not kept, and is
    asked again by the next run. Two runs that ask the same at once keep both answers, of which the earlier counts.
    """

    def __init__(self, spark: SparkSession, path: str, run: str = "", wave: int = 10_000, batch: int = 200):
        self.spark, self.path, self.run, self.wave, self.batch = spark, path.rstrip("/"), run, wave, batch

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self) -> DataFrame:
        """key, answer, run, asked_at: a row per key."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.groupBy("key").agg(F.min_by(F.struct("answer", "run", "asked_at"), F.struct("asked_at", "answer")).alias("x")).select("key", "x.*")

    def ask(self, prompts: DataFrame, call: Callable[..., str | None]) -> DataFrame:
        """key, answer of all prompts (key and the arguments of call), answered now where they weren't before."""
        args = [c for c in prompts.columns if c != "key"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(*(b.column(c).to_pylist() for c in args))
                yield pa.record_batch([b.column("key"), pa.array([call(*(x or "" for x in r)) for r in rows], pa.string())], ["key", "answer"])

        asked = prompts.dropDuplicates(["key"])
        left = asked.join(self.table().select("key"), "key", "left_anti")
        # What all waves ask is found once. A wave is told by the key alone, and reads its own folder.
        n = left.count()
        waves = -(-n // self.wave)
        if waves:
            parts = -(-min(n, self.wave) // FILE)
            wave, part = F.pmod(F.xxhash64("key"), F.lit(waves)), F.pmod(F.hash("key"), F.lit(parts))
            scratch = Scratch(self.spark, "asked")
            by_wave = left.withColumn("wave", wave).repartition(waves * parts, "wave", part)
            kept = scratch.write(by_wave, "left", "wave")
        for w in range(waves):
            mine = kept.where(F.col("wave") == w).drop("wave")
            said = mine.repartition(max(1, -(-n // waves // self.batch)), "key").mapInArrow(run, "key string, answer string").where("answer is not null")
            said.select("key", "answer", F.lit(self.run).alias("run"), F.current_timestamp().alias("asked_at")).write.mode("append").parquet(self.path)
        if waves:
            scratch.drop("left")
        return asked.select("key").join(self.table().select("key", "answer"), "key", "left")
