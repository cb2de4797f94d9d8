"""Quality rules: repetition figures of each document, and lines that too many documents of a host share.

Everything is DataFrame functions. Lines are hashed after normalising; for each host the distinct documents that hold a
line are counted, pre-aggregated in each task. Documents with the same text are one document here, as they are for
near-duplicate removal, which keeps one of them. A line above the limits is removed, and a document of which too
little is left is rejected.

Cases: null or empty text has no words and fails the base rules. Repeated rows are judged row by row and count as
one document. A null host is a host of its own. Very long texts are judged whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, let, row_key, small, split_words, with_window_hashes, without

SPACE, BETWEEN, SYMBOLS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]", "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineLimits:
    """A line goes if over `docs` distinct documents and over `share` of its host's hold it. A document goes if under
    `left_words` words, or under `left_share` of its words, are left."""

    docs: int = 20
    share: float = 0.02
    left_words: int = 20
    left_share: float = 0.25


def _repeat_words(w: Column, hashes: Column) -> Column:
    """Words within windows that occur twice or more. Window hashes tell most texts without any; the rest compare text."""
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))

    def covered(at: Column) -> Column:
        step = lambda acc, i: F.struct(F.greatest(acc.e, i + WINDOW).alias("e"), (acc.n + F.least(F.lit(WINDOW), i + WINDOW - acc.e)).alias("n"))
        return F.aggregate(at, F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")), step, lambda acc: acc.n)

    def exact(s: Column) -> Column:
        """s: (window, start) sorted, so equal windows are neighbours."""
        same = lambda i, j: F.get(s, i).g.eqNullSafe(F.get(s, j).g)
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ((i > 0) & same(i, i - 1)) | ((i < F.size(s) - 1) & same(i, i + 1)))
        return covered(F.array_sort(F.transform(twice, lambda i: F.get(s, i).i)))

    pairs = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, exact)).otherwise(F.lit(0))


def _line(x: Column) -> Column:
    """Lower case, single spaces, digits as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0"))


def _line_hashes(text: Column) -> Column:
    """(hash, words) of each normalised line with a word."""
    words = F.filter(F.transform(F.split(text, "\n"), _line), lambda x: x != "")
    return F.transform(words, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def figures(docs: DataFrame, *keep: Column) -> DataFrame:
    """uid, doc_id, host, the base figures, and hs: (hash, words) of each normalised line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("t"), F.col("source").alias("host"), *keep).withColumn("uid", F.monotonically_increasing_id())
    lines = F.split("t", "\n")
    worded = F.filter(lines, lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    d = d.withColumn("w", split_words(F.col("t"), BETWEEN)).withColumn("ln", worded)
    keep_names = [c for c in d.columns if c not in ("uid", "doc_id", "host", "t", "w", "ln")]
    d = with_window_hashes(d, "w", [WINDOW])
    count = lambda c: F.size(c).cast("long")
    d = d.select(
        "uid", "doc_id", "host", *keep_names,
        count("w").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (count("ln") - count(F.array_distinct("ln"))).alias("n_dup_lines"),
        _repeat_words(F.col("w"), F.col(f"_h{WINDOW}")).cast("long").alias("n_repeat_words"),
        _line_hashes(F.col("t")).alias("hs"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def common_lines(d: DataFrame, limits: LineLimits) -> DataFrame:
    """host, h: the lines above the limits. d has host, hs, and like, a hash of the text."""
    h = F.array_distinct(F.transform("hs", lambda x: x.h))
    # Copies have the same text, so they are one row here.
    of = d.select("host", "like", h.alias("hh"))
    lines = of.select("host", "like", F.explode("hh").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    hosts = of.select("host", "like").distinct().groupBy("host").agg(F.count("*").alias("of"))
    common = lines.where(F.col("n") > limits.docs).alias("f").join(hosts.alias("t"), F.col("f.host").eqNullSafe(F.col("t.host")))
    return common.where(F.col("n") > limits.share * F.col("of")).select("f.host", "h")


def _judged(spark: SparkSession, docs: DataFrame, limits: LineLimits) -> DataFrame:
    """uid, doc_id, the base figures, n_line_words and kept; `key` tells rows of different text or host apart."""
    key = row_key(docs, "text", "source")
    host, lines = F.col("source").alias("host"), _line_hashes(F.coalesce(F.col("text"), F.lit(""))).alias("hs")
    # The lines are counted in a light pass of their own, so that no text or figure is written or shuffled.
    flagged = small(Scratch(spark, "quality").write(common_lines(docs.select(host, lines, F.xxhash64("text").alias("like")), limits), "common"))
    d = figures(docs, key.alias("key"))
    # The first element, which matches no line, keeps a row of each document.
    first = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("n"))
    d = d.select("*", F.posexplode(F.concat(F.array(first), "hs")).alias("at", "x")).drop("hs")
    d = d.join(flagged.select(F.col("host").alias("fh"), F.col("h").alias("fx")), (F.col("x.h") == F.col("fx")) & F.col("host").eqNullSafe(F.col("fh")), "left")
    d = d.where((F.col("at") == 0) | F.col("fx").isNotNull())
    own = [F.max(F.when(F.col("at") == 0, F.col(c))).alias(c) for c in FIGURES]
    d = d.groupBy("uid", "doc_id", "key").agg(*own, F.sum(F.when(F.col("fx").isNotNull(), F.col("x.n")).otherwise(0)).cast("long").alias("n_line_words"))
    left = F.col("n_words") - F.col("n_line_words")
    depleted = (F.col("n_line_words") > 0) & ((left < limits.left_words) | (left < limits.left_share * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(spark: SparkSession, docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """doc_id, the base figures, base_failed, n_line_words (words in removed lines) and kept, a row per document."""
    return _judged(spark, docs.select("doc_id", "text", "source"), limits).select("doc_id", *FIGURES, "n_line_words", "kept")


def filter_quality(spark: SparkSession, docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that the rules keep, with their columns as they were. Equal rows have equal verdicts."""
    gone = Scratch(spark, "quality").write(_judged(spark, docs, limits).where("not kept").select("key").distinct(), "gone")
    return without(docs, gone, "text", "source")


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return quality_rules(spark, docs)
