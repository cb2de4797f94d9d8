"""Findings of a file, what they call for, the risk of it, and where a file goes next. All Column expressions and
aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each flag the transformation it asks for, as (type, target, confidence, priority, description).
TRANSFORMATIONS = {
    "memory_modernization": ("raii_migration", "manual_memory_allocation", 0.95, "high", "Switch malloc/free/new/delete to std::unique_ptr or std::vector."),
    "chrono_upgrade": ("api_upgrade", "c_style_time_api", 0.90, "medium", "Replace std::time_t and localtime with std::chrono::system_clock."),
    "macro_cleanup": ("preprocessor_cleanup", "functional_macros", 0.85, "medium", "Convert functional #define macros into constexpr inline functions."),
    "type_safety": ("type_safety_upgrade", "typedefs_and_casts", 0.95, "low", "Convert typedef to using-aliases and C-casts to static_cast."),
}
FLAGS = ("memory_modernization", "container_upgrade", "string_modernization", "chrono_upgrade", "macro_cleanup", "type_safety")


#: What a text mentions, and what is said of it.
TRIGGERS = {"C-style FILE* API usage": ("FILE*",), "Preprocessor macro usage": ("#define",), "typedef detected": ("typedef",), "legacy C-style time API usage": ("time_t", "localtime")}


def triggers(text: Column) -> dict[str, Column]:
    """Of each finding of a whole text whether it holds."""
    return {what: text.rlike("|".join(r"\Q" + x + r"\E" for x in words)) for what, words in TRIGGERS.items()}


#: What of a reading (extract's only) the findings need.
ANALYZED = ("functions.unique_fqn", "functions.legacy_patterns", "types.fqn")


def analyzer_findings(files: DataFrame, functions: DataFrame, types: DataFrame) -> DataFrame:
    """file_id, finding: of function flags, type definitions and what the text mentions."""
    flag = lambda name, text: F.when(F.col(f"legacy_patterns.{name}"), F.concat(F.lit(text), F.col("unique_fqn")))
    kept = lambda *c: F.explode(F.filter(F.array(*c), lambda x: x.isNotNull())).alias("finding")
    own = functions.select("file_id", kept(flag("has_malloc", "malloc in "), flag("has_free", "free in "), flag("has_printf", "printf in "), flag("has_raw_pointer", "unprotected raw pointer in "), flag("has_null_macro", "NULL macro in ")))
    defs = types.select("file_id", F.concat(F.lit("legacy type definition: "), "fqn").alias("finding")).distinct()
    text = files.select("file_id", kept(*[F.when(c, what) for what, c in triggers(F.col("text")).items()]))
    return own.union(defs).union(text)


def file_metrics(files: DataFrame, functions: DataFrame, findings: DataFrame) -> DataFrame:
    """file_id, n_findings, function_count (by id) of every file."""
    of = lambda df, what, name: df.groupBy("file_id").agg(what.alias(name))
    out = files.select("file_id").distinct().join(of(findings, F.count("*"), "n_findings"), "file_id", "left").join(of(functions, F.countDistinct("unique_fqn"), "function_count"), "file_id", "left")
    return out.na.fill(0, ["n_findings", "function_count"])


def targets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, target: what to work on, general_modernization if nothing else."""
    any_of = lambda regex: F.max(F.col("finding").rlike(regex))
    f = findings.groupBy("file_id").agg(any_of("malloc|pointer").alias("m"), any_of("printf|FILE").alias("i"), any_of("typedef|macro|type definition").alias("s"))
    t = files.select("file_id", F.col("text").rlike("printf|strcpy").alias("t")).join(f, "file_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = F.filter(F.array(F.when(yes("m"), "memory_management"), F.when(yes("i") | yes("t"), "iostream_upgrade"), F.when(yes("s"), "structural_modernization")), lambda x: x.isNotNull())
    return t.select("file_id", F.explode(F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("general_modernization")))).alias("target"))


def plan(findings: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, n_findings, the flags, n_flags, risk_score, transformations, strategy, target_standard."""
    f, low = F.col("finding"), F.lower("finding")
    rules = (
        f.rlike("malloc|free|pointer"),
        ~f.contains("vector") & (f.contains("malloc") | low.contains("array")),
        f.rlike(r"char\*|strcpy|strcat") | low.contains("string"),
        f.rlike("time|localtime"),
        f.rlike("macro|#define"),
        f.rlike("typedef|cast"),
    )
    g = findings.groupBy("file_id").agg(F.count("*").alias("n_findings"), *[F.max(r).alias(n) for n, r in zip(FLAGS, rules)])
    p = files.select("file_id").distinct().join(g, "file_id", "left").withColumns({"n_findings": F.coalesce("n_findings", F.lit(0)), **{n: F.coalesce(n, F.lit(False)) for n in FLAGS}})
    n = sum((F.col(x).cast("int") for x in FLAGS), F.lit(0))
    step = lambda x: F.struct(*[F.lit(v).alias(k) for k, v in zip(("type", "target", "confidence", "priority", "description"), TRANSFORMATIONS[x])])
    steps = F.filter(F.array(*[F.when(F.col(x), step(x)) for x in TRANSFORMATIONS]), lambda x: x.isNotNull())
    return p.withColumn("n_flags", n).withColumn("risk_score", F.round(F.least(0.05 * F.col("n_findings") + 0.1 * F.col("n_flags"), F.lit(1.0)), 6)).withColumns({"transformations": steps, "strategy": F.lit("comprehensive_modernization"), "target_standard": F.lit("C++17"), "signature_preservation": F.lit(True)})


def route(success: Column, semantic_ok: Column, attempts: Column, max_attempts: Column, error_log: Column) -> Column:
    """Where a file goes after its attempt, of which this is the attempts-th."""
    return F.when(success & semantic_ok, "end").when(attempts >= max_attempts, "end").when(F.coalesce(error_log, F.lit("")) != "", "fixer").when(~semantic_ok, "planner").otherwise("modernizer")


def score(n_patterns: Column, success: Column, semantic_ok: Column) -> Column:
    return F.when(n_patterns == 0, 1.0).otherwise(F.least(F.lit(0.95), F.when(success, 0.8).otherwise(0.2) + F.when(semantic_ok, 0.2).otherwise(0.05)))


def rating(s: Column) -> Column:
    return F.when(s >= 0.9, "EXCEPTIONAL").when(s >= 0.7, "HIGH").when(s >= 0.5, "MEDIUM").otherwise("LOW (MANUAL REVIEW REQUIRED)")
