"""Scalar functions over code, compiler output and model output, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.regexops import lines, strip

# What marks a fenced block, a sanitizer's finding, a crash and a size, the reasons given for a crash, and the end of
# a text that was cut.
FENCE = r"(?is)```(?:cpp|c\+\+|cxx|cc|c)?\s*\n?(.*?)```"
SANITIZER = r"(?i)(?:AddressSanitizer|UndefinedBehaviorSanitizer|LeakSanitizer|ERROR:\s*(?:address|leak|undefined))"
CRASH = r"(?i)segmentation fault|access violation|illegal instruction|floating point exception|aborted|stack overflow"
RESIDENT, ALLOCATED = r"Maximum resident set size \(kbytes\):\s*(\d+)", r"(\d+)\s+byte\(s\)\s+allocated"
CRASHED, SIGNALLED, EXITED = "Process crashed (detected from stderr).", "Process terminated by signal %d (platform-dependent).", "Process exited with non-zero status %d."
SUFFIX = "\n...<truncated>"


def normalize_output(text: Column) -> Column:
    """Unix line ends, no white space at line ends, no blank lines at the end."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, r"(?m)[\t\x0b\f\r \x1c-\x1f]+$", ""), r"\n+\z", "")


def truncate_output(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - len(SUFFIX))), F.lit(SUFFIX))).otherwise(text)


def fenced_code(text: Column) -> Column:
    """The first fenced block, else the whole text, stripped."""
    return strip(F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(F.coalesce(text, F.lit(""))))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def best_block(text: Column) -> Column:
    """Of several fenced blocks the first with a main function, else that of most includes, types and calls, then length."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    score = lambda b: occurrences(b, "#include") * 3 + (occurrences(b, "class ") + occurrences(b, "struct ")) * 2 + occurrences(b, "(")
    ranked = F.array_max(F.transform(blocks, lambda b, i: F.struct(score(b).alias("s"), F.length(strip(b)).alias("n"), (-i).alias("i"), b.alias("b"))))
    mains = F.filter(blocks, lambda b: F.contains(b, F.lit("main(")))
    return F.when(F.size(blocks) == 0, strip(text)).when(F.size(mains) > 0, strip(F.get(mains, F.lit(0)))).otherwise(strip(ranked.b))


def plausible_code(text: Column) -> Column:
    """The fixer's test: 20 characters, and a sign of code."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(strip(t)) >= 20) & t.rlike(r"[;{}]|#include")


def valid_code(text: Column) -> Column:
    """The bridge's test of a reply."""
    s = strip(F.coalesce(text, F.lit("")))
    return (F.length(s) >= 20) & s.rlike("[{;]") & (s != "NO_CHANGE")


def sanitizer_lines(stderr: Column) -> Column:
    return F.transform(F.filter(lines(F.coalesce(stderr, F.lit(""))), lambda x: x.rlike(SANITIZER)), strip)


def crash_reason(exit_code: Column, stderr: Column, timed_out: Column) -> Column:
    return (
        F.when(timed_out, "timeout")
        .when(F.coalesce(stderr, F.lit("")).rlike(CRASH), CRASHED)
        .when(exit_code.isNull(), "execution_error")
        .when(exit_code < 0, F.format_string(SIGNALLED, -exit_code))
        .when(exit_code != 0, F.format_string(EXITED, exit_code))
        .otherwise("")
    )


def crash_reason_of(exit_code: int | None, stderr: str, timed_out: bool) -> str:
    """The same for one run on an executor."""
    if timed_out or exit_code is None:
        return "timeout" if timed_out else CRASHED if re.search(CRASH, stderr) else "execution_error"
    if re.search(CRASH, stderr):
        return CRASHED
    return SIGNALLED % -exit_code if exit_code < 0 else EXITED % exit_code if exit_code else ""


def peak_memory_kb(stderr: Column) -> Column:
    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(stderr, pattern, 1), F.lit("")).cast("long")

    return F.coalesce(number(RESIDENT), _allocated_kb(number(ALLOCATED)))


def _allocated_kb(size: Column) -> Column:
    return F.when(size.isNotNull(), F.greatest(F.lit(1).cast("long"), F.floor(size / 1024)))


def error_location(stderr: Column, label: Column) -> Column:
    """The first line of stderr that names the source."""
    return strip(F.get(F.filter(lines(stderr), lambda x: F.contains(x, label)), F.lit(0)))


def output_path(path: Column) -> Column:
    """Where a rewritten file goes: <stem>_modernized.cpp beside it, unless it is one."""
    return F.when(F.contains(path, F.lit("_modernized.cpp")), path).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_modernized.cpp")))


def output_text(new: Column, old: Column) -> Column:
    """A blank result gives way to the original, and that to a mark."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    return F.when(~blank(new), new).when(F.coalesce(old, F.lit("")) != "", old).otherwise("// empty")
