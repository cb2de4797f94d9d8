"""Tool-style functions: each works below a root and answers with a JSON envelope, or with a DataFrame."""

from __future__ import annotations

import json
import shlex
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import native
from tessera.operators import patterns
from tessera.operators.extract import extract, unnest
from tessera.plans.workflow import Rewriter, lite, modernize
from tessera.sources.files import outputs, read_code, read_source, read_sources, result, safe_path, write_code

__all__ = ["extract_functions", "legacy_patterns", "list_sources", "modernize_file", "print_report", "read_code", "run_binary", "run_compiler", "search", "write_code"]
SUFFIX = "\n...<truncated>"


def _short(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[: limit - len(SUFFIX)] + SUFFIX


def run_compiler(command: str, root: str, directory: str = ".", timeout: int = 30, limit: int = 10_000) -> str:
    """Runs a compiler, and nothing else, without a shell."""
    try:
        parts = shlex.split(command)
        if not native.allowed(parts):
            return result("error", message="only compilers may be run")
        r = subprocess.run(parts, cwd=safe_path(directory, root), capture_output=True, text=True, errors="replace", timeout=timeout)
        return result("success" if r.returncode == 0 else "error", exit_code=r.returncode, stdout=_short(r.stdout, limit), stderr=_short(r.stderr, limit))
    except (OSError, ValueError, subprocess.TimeoutExpired) as e:
        return result("error", message=str(e))


def run_binary(path: str, root: str, timeout: int = 5, limit: int = 10_000) -> str:
    try:
        full = safe_path(path, root)
    except PermissionError as e:
        return result("error", message=str(e))
    if not full.is_file():
        return result("error", message=f"no such file: {path}")
    r = native.run_program(str(full), timeout=timeout)
    return result("success" if r["run_success"] else "error", exit_code=r["exit_code"], timed_out=r["timed_out"], stdout=_short(r["stdout"], limit), stderr=_short(r["stderr"], limit))


def list_sources(spark: SparkSession, path: str, root: str) -> DataFrame:
    return read_sources(spark, str(safe_path(path, root))).select("path", F.octet_length("text").alias("bytes"))


def search(spark: SparkSession, query: str, root: str, pattern: str = "*", limit: int = 500) -> DataFrame:
    """path, line, text of the lines below the root that a pattern finds."""
    return patterns.search_code(read_sources(spark, root, pattern), query, limit)


def extract_functions(spark: SparkSession, path: str) -> DataFrame:
    return unnest(extract(read_source(spark, path)), "functions")


def legacy_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The findings of one file, by line and pattern."""
    return patterns.ordered_findings(read_source(spark, path)).orderBy("position")


def modernize_file(spark: SparkSession, path: str, root: str, output: str | None = None, rewriter: Rewriter | None = None, verify: bool = False, light: bool = False) -> str:
    """Rewrites one file and says how it went."""
    try:
        files = read_source(spark, str(safe_path(path, root))).withColumn("path", F.lit(path))
    except (FileNotFoundError, PermissionError) as e:
        return result("error", message=str(e))
    done = lite(files, rewriter).select("file_id", F.col("text").alias("new_text")) if light else modernize(files, rewriter, native.verify if verify else None)
    row = done.drop("text").join(files, "file_id").first()
    out = outputs(spark.createDataFrame([(path, row.text, row.new_text)], "path string, text string, new_text string")).first()
    wrote = json.loads(write_code(output or out.path, out.text, root))
    report = {k: v for k, v in row.asDict(recursive=True).items() if k not in ("text", "new_text", "path", "file_id", "applied")}
    return result(wrote["status"], file=path, output=output or out.path, **report)


def print_report(report: str) -> None:
    """A banner of what modernize_file says."""
    r = json.loads(report)
    width = max(len(k) for k in r)
    print("=" * 48, *(f"{k:<{width}}  {v}" for k, v in r.items()), "=" * 48, sep="\n")


def save_report(report: str, folder: str) -> None:
    Path(folder, "modernization_report.json").write_text(report)
