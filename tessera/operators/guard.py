"""What changed for the worse between two versions of the files: functions gone, parameters and logic that drifted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The messages of issues.
REMOVED = "CRITICAL: Function '%s' missing from modernized code."
SIGNATURE = "WARNING: Parameter count changed in '%s' (%d -> %d)"
LOGIC = "CAUTION: Potential logic deletion in '%s' (complexity dropped %d -> %d)"
MALLOC, FREE = "malloc pattern leaked into output", "free pattern leaked into output"


#: What of a reading (extract's only) the issues need.
COMPARED = ("functions.pos", "functions.unique_fqn", "functions.name", "functions.parameters", "functions.complexity")


def _first(functions: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id", "name").orderBy("pos", "unique_fqn")
    return functions.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file_id", "name", F.size("parameters").alias("params_before"), F.col("complexity").alias("complexity_before"))


def removed_functions(before: DataFrame, after: DataFrame) -> DataFrame:
    """An issue per record of a name that no function has any more."""
    gone = before.join(after.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti")
    return gone.select("file_id", F.lit("regression").alias("category"), F.format_string(REMOVED, "name").alias("message"), F.lit("high").alias("severity"))


def signature_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    x = after.join(_first(before), ["file_id", "name"]).withColumn("n", F.size("parameters")).where("n <> params_before")
    return x.select("file_id", F.lit("signature").alias("category"), F.format_string(SIGNATURE, "name", "params_before", "n").alias("message"), F.lit("medium").alias("severity"))


def logic_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    x = after.join(_first(before), ["file_id", "name"]).where("complexity_before > 5 and complexity < complexity_before / 2")
    return x.select("file_id", F.lit("logic_drift").alias("category"), F.format_string(LOGIC, "name", "complexity_before", "complexity").alias("message"), F.lit("medium").alias("severity"))


def leaks(files: DataFrame) -> DataFrame:
    found = F.array(F.when(F.contains("text", F.lit("malloc")), MALLOC), F.when(F.contains("text", F.lit("free(")), FREE))
    return files.select("file_id", F.lit("leak").alias("category"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("message"), F.lit("medium").alias("severity"))


def _compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """As removed_functions, signature_drift and logic_drift together: both versions meet by one exchange on the name."""
    b = before.select("file_id", "name", F.struct("pos", "unique_fqn", F.size("parameters").alias("params"), "complexity").alias("b"))
    a = after.select("file_id", "name", F.struct(F.size("parameters").alias("params"), "complexity").alias("a"))
    g = b.unionByName(a, allowMissingColumns=True).groupBy("file_id", "name").agg(F.min("b").alias("first"), F.count("b").alias("n"), F.collect_list("a").alias("after"))
    known, first = F.col("file_id").isNotNull() & F.col("name").isNotNull(), F.col("first")
    issue = lambda category, message, severity: F.struct(F.lit(category).alias("category"), message.alias("message"), F.lit(severity).alias("severity"))
    gone = F.when((F.size("after") == 0) | ~known, F.col("n").cast("int")).otherwise(0)
    drift = F.filter("after", lambda x: known & (x.params != first.params))
    less = F.filter("after", lambda x: known & (first.complexity > 5) & (x.complexity < first.complexity / 2))
    found = F.concat(
        F.array_repeat(issue("regression", F.format_string(REMOVED, "name"), "high"), gone),
        F.transform(drift, lambda x: issue("signature", F.format_string(SIGNATURE, "name", first.params, x.params), "medium")),
        F.transform(less, lambda x: issue("logic_drift", F.format_string(LOGIC, "name", first.complexity, x.complexity), "medium")),
    )
    return g.select("file_id", F.explode(found).alias("x")).select("file_id", "x.*")


def issues(before: DataFrame, after: DataFrame, new_files: DataFrame) -> DataFrame:
    """All issues. A file of which nothing was written is in order."""
    blank = new_files.where(F.coalesce(F.regexp_replace("text", r"\s", ""), F.lit("")) == "").select("file_id")
    return _compared(before, after).unionByName(leaks(new_files)).join(blank, "file_id", "left_anti")


def summary(found: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, n_issues, semantic_ok, risk_score of every file."""
    per = found.groupBy("file_id").agg(F.count("*").alias("n"), F.max(F.col("severity") == "high").alias("high"))
    return files.select("file_id").distinct().join(per, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n_issues"), (~F.coalesce("high", F.lit(False))).alias("semantic_ok"), F.round(0.05 * F.coalesce("n", F.lit(0)), 6).alias("risk_score"))
