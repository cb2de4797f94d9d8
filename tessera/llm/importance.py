"""Target-distribution importance resampling: the documents whose hashed n-grams look most like a target's, drawn by chance.

Everything is DataFrame functions.
  1  Each text is cut into words; the runs of 1 to N words that start at a word are exploded, hashed to a bucket by
     crc32 modulo BUCKETS, and counted by bucket for the corpus and the target at once, summed in each task first.
  2  A bucket's gain is a smoothed log ratio of both. The gain table has BUCKETS rows whatever the input, so it is
     broadcast; the n-grams are exploded again, meet it, and are summed by document, in each task first. Nothing but a row
     for each document is shuffled.
  3  A document's score is its weight and Gumbel noise from a hash of its doc_id, so the highest scores are a draw without
     replacement. The rows of long enough documents are sorted over range partitions and written with their place in the
     partition; a rank is that place and what the partitions before hold, of which the driver sees one number each.

A third of all rows in one bucket, or of one text, changes nothing: buckets are summed before the exchange, and the noise
of copies with ids of their own differs.

Cases: null and empty texts have no n-grams, weight 0, and are never drawn. Rows that repeat a doc_id with the same text are
summed as one and returned as often as they came, with ranks of their own; with other texts they are told apart by 128
bits of the text. A null doc_id is hashed as an empty one, comes last among ties, and is kept. A text is one row of its
task, however long: its words are an array in memory, its n-grams are not. Without target texts all t are 0. Extra columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, ascii_lower, split_words

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
N, BUCKETS, SEED, MIN_WORDS, PERCENT = 3, 10_000, 42, 20, 5


def _features(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """A row for each n-gram of the column w, with its bucket, and one of bucket -1 for each row of docs."""
    keep = [c for c in docs.columns if c != "w"]
    at = docs.withColumn("p", F.explode(F.sequence(F.lit(0), F.size("w"))))
    word = lambda k: F.get("w", F.col("p") + (k - 1))
    # An n-gram that the text ends within is null, as concat of a null is.
    grams = [F.concat(*[x for j in range(k) for x in ((F.lit(" "), word(j)) if j else (word(0),))]) for k in range(1, n + 1)]
    hashed = [(F.crc32(g.cast("binary")) % buckets).cast("int") for g in grams]
    rows = F.when(F.col("p") == 0, F.array(F.lit(-1))).otherwise(F.array(*hashed))
    return at.select(*keep, F.explode(rows).alias("bucket")).where("bucket is not null")


def _cut(docs: DataFrame, *keep: Column) -> DataFrame:
    return docs.select(*keep, split_words(ascii_lower(F.col("text")), BETWEEN).alias("w"))


def gains(spark: SparkSession, docs: DataFrame, target: DataFrame, scratch: Scratch, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, s, t, gain: a row for every bucket; a written table."""
    both = _cut(docs, F.lit(0).alias("of")).unionAll(_cut(target, F.lit(1).alias("of")))
    told = _features(both, n, buckets).where("bucket >= 0").groupBy("bucket").agg(F.count_if(F.col("of") == 0).alias("s"), F.count_if(F.col("of") == 1).alias("t"))
    told = scratch.write(told, "counts")
    total = told.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(told), "bucket", "left").na.fill(0, ["s", "t"])
    num = (F.col("t") + 1).cast("double") * F.lit(float(total.s + buckets))
    den = (F.col("s") + 1).cast("double") * F.lit(float(total.t + buckets))
    return scratch.write(every.withColumn("gain", F.floor(1000 * F.log(num / den))), "gains")


def weights(docs: DataFrame, gain: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight: a row per document. gain has a row per bucket."""
    told = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("ka"), F.xxhash64(F.lit(2), "text").alias("kb")]
    met = _features(_cut(docs, *told).withColumn("size", F.size("w").cast("long")), n, buckets).join(F.broadcast(gain.select("bucket", "gain")), "bucket", "left")
    rows = F.count_if(F.col("bucket") < 0)
    summed = met.groupBy("doc_id", "ka", "kb", "size").agg(rows.alias("rows"), (F.count_if(F.col("bucket") >= 0)).alias("f"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
    one = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return one.select("doc_id", F.col("size").alias("n_words"), F.expr("f div rows").alias("n_features"), F.expr("g div rows").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) for Gumbel noise g, told by the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows, a written table with score and doc_id, and rank: 1, 2, 3.. by falling score, ties to the smaller doc_id."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The low 33 bits of this id are the row's place in its partition, told as the sorted partition is written.
    placed = scratch.write(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "placed")
    before, offsets = 0, []
    for r in placed.groupBy("_part").agg(F.count("*").alias("c")).orderBy("_part").collect():
        offsets.append((r["_part"], before))
        before += r["c"]
    offsets = spark.createDataFrame(offsets, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias("rank"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: a row per document. Of the documents of min_words or more the
    highest scores, percent of their number rounded down, have a rank; others have null."""
    scratch = Scratch(spark, "importance")
    w = weights(docs, gains(spark, docs, target, scratch, n, buckets), n, buckets)
    scored = scratch.write(w.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    long_enough = F.col("n_words") >= min_words
    drawn = scored.where(long_enough).count() * percent // 100
    out = ranked(spark, scored.where(long_enough), scratch)
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def op12(spark: SparkSession, docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(spark, docs, target).select("doc_id", "n_features", "weight", "score", "rank")
