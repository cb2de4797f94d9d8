"""Do two programs behave alike? Their runs, case by case, up to the first that differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import normalize_output
from tessera.operators.linediff import unified

_TIMING = r"(?ms)^\s*Command being timed:.*\z"


def cases(runs: DataFrame) -> DataFrame:
    """A row per (pair_id, case_index) with both sides and `same`. Times that a wrapper prints on stderr don't count."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct(F.col("run_success").alias("ok"), normalize_output(F.coalesce("stdout", F.lit(""))).alias("out"), normalize_output(F.regexp_replace(F.coalesce("stderr", F.lit("")), _TIMING, "")).alias("err"), "exit_code", F.coalesce("run_time_ms", F.lit(0)).alias("ms"), "peak_memory_kb", F.coalesce("sanitizer_findings", F.array().cast("array<string>")).alias("found"))))
    c = runs.groupBy("pair_id", "case_index").agg(side("before").alias("b"), side("after").alias("a"))
    same = (F.col("b.out") == F.col("a.out")) & (F.col("b.err") == F.col("a.err")) & F.col("b.exit_code").eqNullSafe(F.col("a.exit_code")) & (F.size("a.found") == 0) & F.col("a.ok") & F.col("b.ok")
    return c.withColumn("same", F.coalesce(same, F.lit(False)))


def differential(runs: DataFrame) -> DataFrame:
    """A row per pair: parity, first_failure, cases_run, total times, memory_delta_kb and the findings, counted up to and with the first failure."""
    c = cases(runs)
    first = F.min(F.when(~F.col("same"), F.col("case_index"))).over(Window.partitionBy("pair_id"))
    c = c.withColumn("first", first).where(F.col("first").isNull() | (F.col("case_index") <= F.col("first")))
    return c.groupBy("pair_id").agg(
        F.min("first").isNull().alias("parity"),
        F.min("first").alias("first_failure"),
        F.count("*").alias("cases_run"),
        F.sum("b.ms").alias("before_ms"),
        F.sum("a.ms").alias("after_ms"),
        (F.max("a.peak_memory_kb") - F.max("b.peak_memory_kb")).alias("memory_delta_kb"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("case_index", F.col("a.found").alias("found")))), lambda x: x.found)).alias("sanitizer_findings"),
    )


def output_diff(pairs: DataFrame) -> DataFrame:
    """id, diff: unified diffs of two text columns, before and after; linediff.line_changes has a row for each change."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            both = zip(b.column("before").to_pylist(), b.column("after").to_pylist())
            yield pa.record_batch([b.column("id"), pa.array([unified(x, y) for x, y in both], pa.string())], ["id", "diff"])

    return pairs.select(F.col("id").cast("long").alias("id"), "before", "after").mapInArrow(run, "id long, diff string")


def keep_recent(entries: DataFrame, capacity: int = 500) -> DataFrame:
    """What a least-recently-used cache of that size holds: key, value, last_used of the latest entries by key."""
    latest = entries.groupBy("key").agg(F.max_by("value", "last_used").alias("value"), F.max("last_used").alias("last_used"))
    return latest.orderBy(F.col("last_used").desc(), "key").limit(capacity)
