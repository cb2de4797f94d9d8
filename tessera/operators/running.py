"""Running sums and numbers over a whole table, in two levels: within range partitions, and over their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import Scratch


def running_sum(df: DataFrame, value: str, order: list[Column], scratch: Scratch, name: str = "running") -> DataFrame:
    """df with `before`: the sum of value over the rows before, by this order, which must tell rows apart.

    The rows are dealt to range partitions and written with their partition's number. The driver sees a total for each
    partition, and adds those up; within one, a window does. So no task has more rows than a partition's, and no row goes
    through one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.write(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), f"{name}-placed")
    sums = placed.groupBy("_part").agg(F.sum(value).alias("s")).orderBy("_part").collect()
    offsets, total = [], 0
    for part, s in sums:
        offsets.append((part, total))
        total += s or 0
    known = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("before", within).join(F.broadcast(known), "_part").withColumn("before", (F.col("before") + F.col("_offset")).cast("long")).drop("_part", "_offset")
