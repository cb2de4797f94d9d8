"""Reading, listing and writing source files below a root."""

from __future__ import annotations

import json
import os
import posixpath
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import output_path, output_text

SOURCES = "*.{c,cc,cpp,cxx,h,hh,hpp,hxx}"
#: Files to a task.
FILES = 4096


def tasks(spark: SparkSession, files: int) -> int:
    """How many tasks that many small files are for. A text may be made from a few bytes, or be much like the others, so the
    table's own partitions, and what Spark makes of an exchange or a written table of such bytes, are a few tasks however many
    the files are."""
    return max(1, min(2 * spark.sparkContext.defaultParallelism, files // 64), files // FILES)


def dealt(files: DataFrame, n: int) -> DataFrame:
    """The files, of which there are about n, in as many tasks as they are for."""
    return files.repartition(tasks(files.sparkSession, n), "file_id")


def read_sources(spark: SparkSession, path: str, pattern: str = SOURCES) -> DataFrame:
    """file_id, path, text of the files below a path; file_id is a hash of the path. Filters on path reach the listing."""
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    # The path as it is, not as in an address.
    p = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return df.select(F.xxhash64(p).alias("file_id"), p.alias("path"), F.col("value").alias("text"))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """One file; a FileNotFoundError if it isn't there."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return read_sources(spark, path, "*")


def safe_path(path: str, root: str) -> Path:
    """The path, resolved, if it is below the root; else a PermissionError."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise PermissionError(f"{path} is outside {root}")
    return full


def list_directory(spark: SparkSession, path: str, root: str) -> DataFrame:
    """name and type (file or directory) of a folder's own entries, by name: of any folder that Spark reads, below the root.
    datasource.SourceFiles lists all that is below one, in tasks."""
    if "://" in root:
        full = posixpath.normpath(path or ".")
        if full.startswith(("/", "..")):
            raise PermissionError(f"{path} is outside {root}")
        where = root.rstrip("/") + "/" + full
    else:
        where = safe_path(path, root).as_uri()
    at = spark._jvm.org.apache.hadoop.fs.Path(where)
    entries = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    rows = [(e.getPath().getName(), "directory" if e.isDirectory() else "file") for e in entries]
    return spark.createDataFrame(rows, "name string, type string").orderBy("name")


def result(status: str, **data) -> str:
    """The JSON envelope of tool-style answers."""
    return json.dumps({"status": status, **data}, indent=2, default=str)


def read_code(path: str, root: str) -> str:
    try:
        return result("success", content=safe_path(path, root).read_text("utf-8"))
    except (OSError, UnicodeDecodeError) as e:
        return result("error", message=str(e))


def write_code(path: str, content: str, root: str) -> str:
    """Reports the bytes that were written, of UTF-8."""
    try:
        full = safe_path(path, root)
        full.parent.mkdir(parents=True, exist_ok=True)
        data = content.encode()
        full.write_bytes(data)
        return result("success", bytes_written=len(data))
    except OSError as e:
        return result("error", message=str(e))


def outputs(results: DataFrame) -> DataFrame:
    """path and text to write, of rows with path, text (the original) and new_text."""
    return results.select(output_path(F.col("path")).alias("path"), output_text(F.col("new_text"), F.col("text")).alias("text"))


def write_outputs(results: DataFrame, target: str) -> None:
    """A Parquet table of (path, text); each task writes its own part."""
    outputs(results).write.mode("overwrite").parquet(target)


def report(results: DataFrame) -> DataFrame:
    """file and a JSON report (file, metrics, semantic, verification) of each row of what modernize returns; the file is
    its path, or its file_id where there is none."""
    name = F.col("path" if "path" in results.columns else "file_id").cast("string").alias("file")
    metrics = F.struct(F.col("n_findings").alias("legacy_pattern_count"), "function_count", "attempts", "score", "rating")
    semantic = F.struct("semantic_ok", F.round(0.05 * F.col("n_issues"), 6).alias("risk_score"), "issues")
    verification = F.struct("success", "error_log")
    return results.select(name, F.to_json(F.struct(name, metrics.alias("metrics"), semantic.alias("semantic"), verification.alias("verification"))).alias("report"))


def write_reports(results: DataFrame, target: str) -> None:
    """A JSON line for each file; each task writes its own part."""
    report(results).select(F.col("report").alias("value")).write.mode("overwrite").text(target)


def declaration_edges(parsed: DataFrame) -> DataFrame:
    """file_id, child, parent: each type and function by its qualified name, and the type that encloses it, if any."""
    names = F.array_distinct(F.concat(F.transform("types", lambda x: x.fqn), F.transform("functions", lambda x: x.fqn)))
    n = parsed.select("file_id", names.alias("names"), F.transform("types", lambda x: x.fqn).alias("of")).select("file_id", "of", F.explode("names").alias("child"))
    outer = F.regexp_replace("child", r"::[^:]+$", "")
    return n.select("file_id", "child", F.when(F.array_contains("of", outer) & (outer != F.col("child")), outer).alias("parent"))


def token_graph(text: str, limit: int = 1000) -> str:
    """Graphviz DOT of the declarations of one text: a node per type and function, an edge to what encloses it."""
    from tessera.operators.extract import read_text

    r = read_text(text)
    names = list(dict.fromkeys([t["fqn"] for t in r["types"]] + [f["fqn"] for f in r["functions"]]))[:limit]
    at = {n: i + 1 for i, n in enumerate(names)}
    nodes = ['  n0 [label="file"];'] + [f'  n{i} [label="{n}"];' for n, i in at.items()]
    arcs = [f"  n{at.get(n.rpartition('::')[0], 0)} -> n{i};" for n, i in at.items()]
    return "digraph declarations {\n" + "\n".join(nodes + arcs) + "\n}\n"
