"""Size-checked broadcasts, words, row keys and the reading of a table, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from tessera.sources.scratch import Scratch, scratch_root

__all__ = ["Scratch", "ascii_lower", "fits", "free_shuffles", "held_out", "let", "row_key", "scratch_root", "small", "split_words", "table", "with_window_hashes", "without"]

#: A frame is broadcast only if it has been measured and holds at most so many rows and, of texts and arrays, bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df, a written table, may be broadcast: it is counted, and measured if it holds texts or arrays."""
    n = df.count()
    if n > (BROADCAST_ROWS if rows is None else rows):
        return False
    if not any(isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType)) for f in df.schema):
        return True
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a written table, marked for broadcast if it fits, else as it is."""
    return F.broadcast(df) if fits(df, rows) else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def split_words(text: Column, between: str) -> Column:
    """What is left of a text when stretches of that class of characters are taken out; null has no words. Cutting is far
    cheaper than a regular expression for the words themselves."""
    return F.coalesce(F.array_remove(F.split(text, between + "+"), ""), F.array().cast("array<string>"))


def with_window_hashes(df: DataFrame, words: str, sizes: list[int], name: str = "_h") -> DataFrame:
    """df with a column name + m for each size m: a hash of each m consecutive words, by place.

    A word is hashed once; windows of 2, 4, 8 .. words combine two of half the size, and others add up such. Cutting each
    window out of the array takes far longer.
    """

    def joined(a: str, b: str, k: int) -> Column:
        n = F.greatest(F.size(b) - k, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, k + 1, n), lambda x, y: F.xxhash64(x, y))

    of = lambda m: f"{name}{m}"
    df, m = df.withColumn(of(1), F.transform(words, lambda x: F.xxhash64(x))), 1
    while 2 * m <= max(sizes):
        df, m = df.withColumn(of(2 * m), joined(of(m), of(m), m)), 2 * m
    for size in sorted(set(sizes)):
        have = 1 << (size.bit_length() - 1)
        own = of(have)
        while have < size:
            more = 1 << ((size - have).bit_length() - 1)
            step = of(size) if have + more == size else f"{of(size)}_{have + more}"
            df, own, have = df.withColumn(step, joined(own, of(more), have)), step, have + more
    return df


def row_key(docs: DataFrame, *columns: str) -> Column:
    """128 bits that tell rows apart by these columns, of which nulls are told from empty texts."""
    told = [F.coalesce(F.concat(F.lit("1"), F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("0")) for c in columns]
    return F.md5(F.concat(*told))


def without(docs: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """The rows of docs whose row_key by these columns is not among gone (key), a written table."""
    name = "_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, row_key(docs, *columns)).join(small(gone.withColumnRenamed("key", name)), name, "left_anti").select(*docs.columns)


def held_out(doc_id: Column, remainder: int) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) == remainder


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
