"""Findings of a pattern catalogue with line numbers, and line search. All on Column expressions but for casts, which
come from the reading of extract."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.regexops import matches, strip
from tessera.operators.extract import extract
from tessera.operators.running import running_sum
from tessera.sources.scratch import Scratch

TAG = "C++23 Overhaul"


@dataclass(frozen=True)
class Pattern:
    name: str
    severity: str
    regex: str
    message: str


# Fixed values.
LEGACY = (
    Pattern("char_pointer_array", "critical", r"\bchar\s*\*\s*[A-Za-z_][A-Za-z0-9_]*\s*(\[[^\]]*\])", "char* array usage detected; prefer std::string/std::array/std::span."),
    Pattern("null_macro", "major", r"\bNULL\b", "NULL macro detected; replace with nullptr."),
    Pattern("manual_delete", "critical", r"\bdelete\s*(\[\])?\s*[A-Za-z_][A-Za-z0-9_]*\s*;", "Manual delete detected; prefer std::unique_ptr or stack allocation."),
)
CAST = Pattern("c_style_cast", "major", "", "Potential C-style cast detected; prefer static_cast/reinterpret_cast.")
#: Fixed values. A file is passed over if its path holds one of these anywhere, as in rebuild/.
IGNORED_DIRS = ("node_modules", ".git", "build", ".venv", "__pycache__")


def scan_patterns(files: DataFrame, catalogue: tuple[Pattern, ...] = LEGACY, text: Column | None = None) -> DataFrame:
    """file_id, pattern, severity, line, match, message, tag. Patterns are literals, compiled once a task."""
    text = F.col("text") if text is None else text

    def found(p: Pattern) -> Column:
        return F.transform(matches(text, p.regex), lambda m: F.struct(F.lit(p.name).alias("pattern"), F.lit(p.severity).alias("severity"), m["line"].alias("line"), m["match"].alias("match"), F.lit(p.message).alias("message")))

    per = [found(p) for p in catalogue]
    return files.select("file_id", F.explode(F.concat(*per)).alias("f")).select("file_id", "f.*", F.lit(TAG).alias("tag"))


def cast_findings(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode("casts").alias("c")).select("file_id", F.lit(CAST.name).alias("pattern"), F.lit(CAST.severity).alias("severity"), "c.line", "c.match", F.lit(CAST.message).alias("message"), F.lit(TAG).alias("tag"))


def ordered_findings(files: DataFrame) -> DataFrame:
    """All findings of each file with `position` from 1: by line, then by pattern, then as they come."""

    def found_by(p: Pattern) -> Column:
        return F.transform(matches(F.col("text"), p.regex), lambda m, i: F.struct(F.lit(p.name).alias("pattern"), F.lit(p.severity).alias("severity"), m["line"].alias("line"), i.alias("i"), m["match"].alias("match"), F.lit(p.message).alias("message")))

    per = [found_by(p) for p in LEGACY]
    found = files.select("file_id", F.explode(F.concat(*per)).alias("f")).select("file_id", "f.*")
    c = extract(files, only=("casts",)).select("file_id", F.posexplode("casts").alias("i", "c")).select("file_id", F.lit(CAST.name).alias("pattern"), F.lit(CAST.severity).alias("severity"), "c.line", "i", "c.match", F.lit(CAST.message).alias("message"))
    by = Window.partitionBy("file_id").orderBy("line", "pattern", "i")
    return found.unionByName(c).select("file_id", F.row_number().over(by).alias("position"), "pattern", "severity", "line", "match", "message", F.lit(TAG).alias("tag"))


def _lines(files: DataFrame, *keep: str) -> DataFrame:
    kept = files.where(~F.coalesce(F.col("path"), F.lit("")).rlike("|".join(r"\Q" + d + r"\E" for d in IGNORED_DIRS)))
    return kept.select("path", *keep, F.posexplode(F.split("text", r"\r?\n")).alias("i", "text"))


def search_lines(files: DataFrame, regex: str) -> DataFrame:
    """path, line, text of each line that the pattern finds; files whose path holds an ignored name are passed over."""
    return _lines(files).where(F.col("text").rlike(regex)).select("path", (F.col("i") + 1).alias("line"), strip(F.col("text")).alias("text"))


def search_lines_for(files: DataFrame, regexes: tuple[str, ...], held: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """expression (its place), path, line, text: as search_lines for each of the patterns, by one reading of the lines. A
    pattern is looked for in the files whose array `wanted` has a true value at its place, and on the lines that hold all of
    its strings in held, which must be on each line that it finds."""
    holds = [[F.contains("text", F.lit(x)) for x in held[i]] if held else [] for i in range(len(regexes))]
    found = [reduce(and_, [F.get("wanted", F.lit(i)), *holds[i], F.col("text").rlike(x)]) for i, x in enumerate(regexes)]
    which = F.filter(F.array(*[F.when(x, F.lit(i)) for i, x in enumerate(found)]), lambda x: x.isNotNull())
    return _lines(files, "wanted").where(reduce(or_, found)).select(F.explode(which).alias("expression"), "path", (F.col("i") + 1).alias("line"), strip(F.col("text")).alias("text"))


def search_code(files: DataFrame, regex: str, limit: int = 500) -> DataFrame:
    """As search_lines, up to and with the file, by path, that brings the matches over the limit."""
    hits = search_lines(files, regex)
    per_file = hits.groupBy("path").agg(F.count("*").alias("n"))
    counted = running_sum(per_file, "n", [F.col("path")], Scratch(files.sparkSession, "search"))
    return hits.join(counted.where(F.col("before") <= limit).select("path"), "path", "left_semi")


def error_context(errors: DataFrame, files: DataFrame, around: int = 2, first: int = 3) -> DataFrame:
    """file_id, error_line, line, text: the lines about the first distinct error lines of each file's compiler output."""
    found = F.transform(F.regexp_extract_all("error_text", F.lit(r":(\d+)(?::\d+)?:"), F.lit(1)), lambda x: x.cast("int"))
    wanted = errors.select("file_id", F.explode(F.slice(F.array_sort(F.array_distinct(found)), 1, first)).alias("error_line"))
    code = files.join(wanted.groupBy("file_id").agg(F.collect_set("error_line").alias("want")), "file_id")
    return (
        code.select("file_id", "want", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
        .select("file_id", (F.col("i") + 1).alias("line"), "text", F.explode("want").alias("error_line"))
        .where(F.abs(F.col("line") - F.col("error_line")) <= around)
        .select("file_id", "error_line", "line", "text")
    )
