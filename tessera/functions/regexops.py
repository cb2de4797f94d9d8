"""Text idioms as Column expressions: masking, matches with line numbers, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, string and character literals, then runs of anything else. Possessive, so no input can exhaust the regex stack.
TOKEN = r"""(?s)//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^/"']++|."""

#: Which of those tokens are comments and literals: a quote that closes nothing is a token by itself.
LITERAL = r"""(?s)\A(?://|/\*|["'].)"""


def mask(text: Column) -> Column:
    """Comments and literals blanked; length and newlines stay."""
    blank = lambda t: F.when(t.rlike(LITERAL), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), blank), "")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<k, line, match>>: the matches of a pattern that never matches the empty text. A line is counted from 1.

    One pass over the gaps between matches carries the line on; null text has none.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g")))

    def step(acc: Column, p: Column) -> Column:
        line = acc.line + newlines(F.coalesce(p.g, F.lit("")))
        return F.struct((line + newlines(F.coalesce(p.h, F.lit("")))).alias("line"), F.concat(acc.out, F.array(line)).alias("out"))

    lines = F.aggregate(pairs, F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc.out)
    return F.zip_with(hits, lines, lambda h, n: F.struct(n.alias("line"), h.alias("match")))


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\A\s+", ""), r"\s+\z", "")


def has_word(text: Column, word: str) -> Column:
    """The symbol as a whole word."""
    return text.rlike(r"(?<!\w)\Q" + word + r"\E(?!\w)")
