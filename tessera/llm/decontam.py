"""Benchmark decontamination with DataFrame functions alone.

The benchmark's word windows are hashed into a small broadcast set. A document turns into an array of window hashes,
which is exploded inside the stage that probes the set, so that nothing but hits ever leaves the task; the text of a
hit window is compared before it counts.

Cases: null or empty text has no words and is never hit. A null or empty item has no windows. Repeated rows give a row
each. A null doc_id is kept. Equal items count one by one, by item_id; a null item_id counts as the string "null".
Columns of the input other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, ascii_lower, fits, split_words, with_window_hashes

#: What stands between words: any ASCII character but a digit or a letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WINDOW = 10


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), BETWEEN)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item string, m int, h long, win string: the distinct windows of each item."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = with_window_hashes(w.withColumn("m", F.least(F.lit(size), F.size("w"))), "w", list(range(1, size + 1)))
    w = w.select("item", "m", "w", F.posexplode(F.element_at(F.array(*[F.col(f"_h{m}") for m in range(1, size + 1)]), F.col("m"))).alias("i", "h"))
    return w.select("item", "m", "h", F.array_join(F.slice("w", F.col("i") + 1, F.col("m")), " ").alias("win")).distinct()


def window_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row per document with uid, doc_id, n_words, n_hit, items (sorted array of item ids).

    If the windows fit, they are broadcast, and a document's hashes are probed in the stage that makes them. Else only
    (key of the document's words, place, hash) is shuffled to meet them, and the words are read again for what was found.
    """
    scratch = Scratch(spark, "decontam")
    wins = scratch.write(benchmark_windows(benchmark, size).groupBy("m", "h", "win").agg(F.array_sort(F.collect_set("item")).alias("of")), "windows")
    # An item shorter than a window is a window of its own length, so at most `size` lengths occur.
    lengths = sorted(r.m for r in wins.select("m").distinct().collect()) or [size]
    d = docs.select("doc_id", F.col("text").alias("t")).select("doc_id", words(F.col("t")).alias("w"))
    d = with_window_hashes(d, "w", lengths)
    n = F.size("w")
    # A first element that matches nothing keeps a row of each document without a second pass.
    hashes = F.concat(F.array(F.lit(None).cast("long")), *[F.col(f"_h{m}") for m in lengths])
    start, length, before = F.col("idx"), F.lit(lengths[0]), F.lit(0)
    for a, b in zip(lengths, lengths[1:]):
        before = before + F.greatest(F.col("n_words") - (a - 1), F.lit(0))
        start = F.when(F.col("idx") > before, F.col("idx") - before).otherwise(start)
        length = F.when(F.col("idx") > before, F.lit(b)).otherwise(length)
    if fits(wins):
        d = d.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "w", n.alias("n_words"), hashes.alias("hs"))
        found = d.select("uid", "doc_id", "n_words", "w", F.posexplode("hs").alias("idx", "h")).join(F.broadcast(wins), "h", "left").where((F.col("idx") == 0) | F.col("win").isNotNull())
    else:
        key = F.md5(F.array_join("w", " "))
        grams = d.select(key.alias("key"), F.posexplode(hashes).alias("idx", "h")).where("idx > 0")
        meet = grams.join(wins, "h").distinct().groupBy("key").agg(F.collect_list(F.struct("idx", "m", "win", "of")).alias("met"))
        none = F.struct(F.lit(0).alias("idx"), F.lit(None).cast("int").alias("m"), F.lit(None).cast("string").alias("win"), F.lit(None).cast("array<string>").alias("of"))
        d = d.withColumn("key", key).join(meet, "key", "left").withColumn("uid", F.monotonically_increasing_id())
        d = d.select("uid", "doc_id", "w", n.alias("n_words"), F.explode(F.concat(F.array(none), F.coalesce("met", F.array().cast("array<struct<idx: int, m: int, win: string, of: array<string>>>")))).alias("x"))
        found = d.select("uid", "doc_id", "n_words", "w", "x.*")
    hits = found.select("uid", "doc_id", "n_words", start.alias("start"), length.alias("len"), "m", "win", "of", F.when(F.col("idx") > 0, F.array_join(F.slice("w", F.greatest(start, F.lit(1)), length), " ")).alias("seen")).where(
        F.col("seen").isNull() | ((F.col("seen") == F.col("win")) & (F.col("len") == F.col("m")))
    )
    hit = F.col("seen").isNotNull()
    hits = hits.select("uid", "doc_id", "n_words", F.when(hit, F.col("start")).alias("start"), F.when(hit, F.col("start") + F.col("len")).alias("end"), "of")
    # Windows overlap: each adds the words beyond the furthest end before it.
    by = Window.partitionBy("uid").orderBy(F.col("start").asc_nulls_first(), "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(by), F.lit(0))
    spans = hits.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reach)))
    return spans.groupBy("uid", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("start").isNull(), 0).otherwise(F.col("new"))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("of")))).alias("items"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated: what of each document occurs in the benchmark."""
    r = window_hits(spark, docs, benchmark, size)
    return r.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def op1(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    r = decontaminate(spark, docs, benchmark)
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
