"""The queries over the driver's tables, each with its DuckDB SQL where SQL can express it.

The code corpus is made from part (sources.corpus), so what the reading of the code must find is told by SQL over part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import flow_queries, unit_queries
from tessera.functions import text as T
from tessera.functions.regexops import mask
from tessera.operators import graph, guard, includes, parity, patterns
from tessera.operators.extract import call_table, extract, unnest
from tessera.operators.rules import apply_rules
from tessera.plans import plan as P
from tessera.plans.workflow import modernize
from tessera.sources.corpus import FILE, FILE_ID, FUNCTION, code_corpus, corpus_sql
from tessera.sources.files import outputs
from tessera.unit_queries import read_once

_queries, _oracle = {}, {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark, sf_dir, what, *fields):
    return unnest(extract(code_corpus(spark, sf_dir), only=tuple(f"{what}.{x}" for x in fields) or (what,)), what)


# Facts of the corpus, in SQL that needs only part.
_TYPES = "CASE WHEN p_partkey % 4 = 0 THEN 'const char,int' WHEN p_partkey % 4 = 1 THEN 'char' ELSE 'int' END"
_ID = f"concat('fn_', p_partkey, '#', substr(md5({_TYPES}), 1, 8))"
_CALLS = f"(p_partkey % {FILE} >= 7)"
_FACTS = f"""(SELECT {FILE_ID} AS file_id, p_partkey AS k, concat('fn_', p_partkey) AS name, {_ID} AS id, {_TYPES} AS types, {_CALLS} AS calls FROM part) t"""
_EDGES = f"(SELECT a.file_id, a.id AS src, b.id AS dst FROM {_FACTS.replace(') t', ')')} a JOIN {_FACTS.replace(') t', ')')} b ON b.k = a.k - 7 AND b.file_id = a.file_id) e"
_DEGREES = f"""(SELECT f.file_id, f.id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM {_FACTS.replace(') t', ')')} f
    LEFT JOIN (SELECT file_id, dst, count(*) AS n FROM {_EDGES} GROUP BY ALL) i ON i.file_id = f.file_id AND i.dst = f.id LEFT JOIN (SELECT file_id, src, count(*) AS n FROM {_EDGES} GROUP BY ALL) o ON o.file_id = f.file_id AND o.src = f.id) d"""
_CLASS = "CASE WHEN n_out = 0 THEN 'leaf' WHEN n_in >= 2 AND n_out <= 1 THEN 'root' ELSE 'middle' END"
_CORPUS = corpus_sql()
_LINES = f"(SELECT file_id, path, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {_CORPUS} c)"


@query(f"SELECT file_id, 'null_macro' AS pattern, 'major' AS severity, line, unnest(regexp_extract_all(line_text, '\\bNULL\\b')) AS match FROM {_LINES}")
def pattern_findings(spark, sf_dir):
    return patterns.scan_patterns(code_corpus(spark, sf_dir)).select("file_id", "pattern", "severity", F.col("line").cast("long").alias("line"), "match")


@query(f"SELECT pattern, severity, count(*) AS n, count(DISTINCT file_id) AS n_files FROM (SELECT {FILE_ID} AS file_id, 'null_macro' AS pattern, 'major' AS severity FROM part UNION ALL SELECT {FILE_ID}, 'c_style_cast', 'major' FROM part WHERE p_partkey % 5 = 0) GROUP BY ALL")
def pattern_counts(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    found = patterns.scan_patterns(files).unionByName(patterns.cast_findings(extract(files, only=("casts",))))
    return found.groupBy("pattern", "severity").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


_BLANK = r"""array_to_string(list_transform(regexp_extract_all(text, '(?s)//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|[^/"'']+|.'), lambda x: CASE WHEN x LIKE '//%' OR x LIKE '/*%' OR (length(x) > 1 AND (x LIKE '"%' OR x LIKE '''%')) THEN regexp_replace(x, '[^\n]', ' ', 'g') ELSE x END), '')"""


@query(f"SELECT file_id, length(m) AS n, md5(m) AS masked_md5 FROM (SELECT file_id, {_BLANK} AS m FROM {_CORPUS} c)")
def masked_text_hash(spark, sf_dir):
    return code_corpus(spark, sf_dir).select("file_id", mask(F.col("text")).alias("m")).select("file_id", F.length("m").cast("long").alias("n"), F.md5("m").alias("masked_md5"))


_TIMES = [("NULL -> nullptr", "p_partkey % 3 = 0"), ("char* pointer - consider std::string or std::string_view", "p_partkey % 4 < 2"), ("printf detected - consider std::cout or std::print (C++23)", "p_partkey % 5 <> 0"), ("malloc usage - migrate to make_unique / vector", "p_partkey % 5 = 0"), ("free usage - replace with smart pointer ownership", "p_partkey % 5 = 0"), *[(x, f"p_partkey % {FILE} = 0") for x in ("typedef -> using", "#define constant -> constexpr", "<stdio.h> -> <cstdio>", "<stdlib.h> -> <cstdlib>")]]


@query(" UNION ALL ".join(f"SELECT '{d}' AS description, count(*) AS times, count(DISTINCT {FILE_ID}) AS n_files FROM part WHERE {w}" for d, w in _TIMES))
def rule_apply_counts(spark, sf_dir):
    a = apply_rules(code_corpus(spark, sf_dir)).select("file_id", F.explode("applied").alias("a"))
    return a.groupBy("a.description").agg(F.sum("a.times").alias("times"), F.count("*").alias("n_files"))


_REWRITTEN = r"regexp_replace(regexp_replace(replace(replace(replace(text, '== NULL', '== nullptr'), '#include <stdio.h>', '#include <cstdio>'), '#include <stdlib.h>', '#include <cstdlib>'), '#define (LIMIT_\d+) 10', 'constexpr auto \1 = 10;', 'g'), 'typedef unsigned long (ulong_\d+);', 'using \1 = unsigned long;', 'g')"


@query(f"SELECT file_id, md5({_REWRITTEN}) AS text_md5 FROM {_CORPUS} c")
def rewritten_text_hash(spark, sf_dir):
    return apply_rules(code_corpus(spark, sf_dir)).select("file_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, text LIKE '%FILE*%' AS has_file, text LIKE '%#define%' AS has_define, text LIKE '%typedef%' AS has_typedef, text LIKE '%time_t%' OR text LIKE '%localtime%' AS has_time FROM documents")
def file_triggers(spark, sf_dir):
    names = ("has_file", "has_define", "has_typedef", "has_time")
    return _t(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in zip(names, P.triggers(F.col("text")).values())])


@query(f"SELECT path, line, trim(line_text) AS text FROM {_LINES} WHERE regexp_matches(line_text, 'malloc|std::')")
def line_search(spark, sf_dir):
    return patterns.search_lines(code_corpus(spark, sf_dir), "malloc|std::").withColumn("line", F.col("line").cast("long"))


@query(f"WITH h AS (SELECT path, line, trim(line_text) AS text FROM {_LINES} WHERE regexp_matches(line_text, 'malloc')), b AS (SELECT path, coalesce(sum(count(*)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h GROUP BY path) SELECT h.* FROM h JOIN b USING (path) WHERE before <= 50")
def line_search_limited(spark, sf_dir):
    return patterns.search_code(code_corpus(spark, sf_dir), "malloc", 50).withColumn("line", F.col("line").cast("long"))


@query(f"SELECT file_id, name, id AS unique_fqn, 7 + (k % 7 = 0)::INT AS loc, (k % 7 = 0)::INT + (k % 3 = 0)::INT + CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END + calls::INT AS complexity, false AS is_template, 'static' AS modifiers FROM {_FACTS}")
def functions(spark, sf_dir):
    return _parts(spark, sf_dir, "functions", "name", "unique_fqn", "loc", "complexity", "is_template", "modifiers").select("file_id", "name", "unique_fqn", "loc", "complexity", "is_template", F.array_join("modifiers", ",").alias("modifiers"))


@query(f"SELECT file_id, id AS unique_fqn, k % 4 <> 0 AS has_raw_pointer, k % 5 <> 0 AS has_printf, k % 5 = 0 AS has_malloc, k % 5 = 0 AS has_free, true AS has_null_macro FROM {_FACTS}")
def function_flags(spark, sf_dir):
    return _parts(spark, sf_dir, "functions", "unique_fqn", "legacy_patterns").select("file_id", "unique_fqn", "legacy_patterns.*")


@query(f"SELECT file_id, id AS unique_fqn, 0 AS pos, CASE WHEN k % 4 < 2 THEN 'arg' ELSE 'n' END AS name, split_part(types, ',', 1) AS type, k % 4 < 2 AS is_pointer, k % 4 = 0 AS is_const FROM {_FACTS} UNION ALL SELECT file_id, id, 1, 'n', 'int', false, false FROM {_FACTS} WHERE k % 4 = 0")
def parameters(spark, sf_dir):
    return _parts(spark, sf_dir, "functions", "unique_fqn", "parameters").select("file_id", "unique_fqn", F.posexplode("parameters").alias("pos", "p")).select("file_id", "unique_fqn", "pos", "p.name", "p.type", "p.is_pointer", "p.is_const")


@query(f"SELECT file_id, name, substr(md5(types), 1, 8) AS signature_hash, id AS unique_fqn FROM {_FACTS}")
def signature_ids(spark, sf_dir):
    return _parts(spark, sf_dir, "functions", "name", "signature_hash", "unique_fqn").select("file_id", "name", "signature_hash", "unique_fqn")


_CODE = FUNCTION.replace("'[^A-Za-z0-9 ]', '_')", "'[^A-Za-z0-9 ]', '_', 'g')")


@query(f"SELECT {FILE_ID} AS file_id, concat('fn_', p_partkey) AS name, sha256(regexp_extract({_CODE}, '(?s)[)] ([{{]\n.*[}}])\n\n$', 1)) AS function_hash FROM part")
def body_hashes(spark, sf_dir):
    return _parts(spark, sf_dir, "functions", "name", "function_hash").select("file_id", "name", "function_hash")


@query(f"SELECT file_id, src, dst FROM {_EDGES}")
def calls_resolved(spark, sf_dir):
    return graph.edges(graph.resolved_calls(extract(code_corpus(spark, sf_dir), only=graph.CALLS)))


@query(f"SELECT file_id, id AS src, unnest(CASE WHEN k % 5 = 0 THEN ['malloc', 'free'] ELSE ['printf'] END) AS display FROM {_FACTS}")
def external_calls(spark, sf_dir):
    return graph.external_calls(graph.resolved_calls(extract(code_corpus(spark, sf_dir), only=graph.CALLS)))


def _corpus_degrees(spark, sf_dir):
    return graph.call_degrees(extract(code_corpus(spark, sf_dir), only=graph.CALLS))


@query(f"SELECT file_id, id, n_in, n_out, n_out = 0 AS is_leaf, n_in >= 2 AND n_out <= 1 AS is_root FROM {_DEGREES}")
def call_degrees(spark, sf_dir):
    d = _corpus_degrees(spark, sf_dir)
    return d.select("file_id", "id", F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"), "is_leaf", "is_root")


@query(f"SELECT file_id, id, {_CLASS} AS node_class, row_number() OVER (PARTITION BY file_id ORDER BY CASE {_CLASS} WHEN 'leaf' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, CASE {_CLASS} WHEN 'leaf' THEN n_in WHEN 'middle' THEN n_out ELSE -n_in END, CASE {_CLASS} WHEN 'leaf' THEN 0 WHEN 'middle' THEN -n_in ELSE n_out END, id) AS position FROM {_DEGREES}")
def priority_order(spark, sf_dir):
    return graph.priority_order(_corpus_degrees(spark, sf_dir)).select("file_id", "id", "node_class", F.col("position").cast("long").alias("position"))


_STAR = "SELECT DISTINCT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst FROM lineitem"


@query(f"WITH e AS ({_STAR}), d AS (SELECT id, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id) SELECT {_CLASS} AS node_class, count(*) AS n, CAST(sum(n_in) AS BIGINT) AS total_in, CAST(sum(n_out) AS BIGINT) AS total_out FROM d GROUP BY ALL")
def node_classes(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    e = li.select(F.lit(0).alias("file_id"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    nodes = e.select("file_id", F.col("src").alias("id")).union(e.select("file_id", "dst"))
    return graph.degrees(nodes, e).groupBy("node_class").agg(F.count("*").alias("n"), F.sum("n_in").cast("long").alias("total_in"), F.sum("n_out").cast("long").alias("total_out"))


@query(f"SELECT file_id, id, '<vector>' AS header FROM {_FACTS} WHERE k % 7 = 0")
def include_requirements(spark, sf_dir):
    parsed = read_once(spark, code_corpus(spark, sf_dir))
    return includes.include_requirements(unnest(parsed, "functions"), unnest(parsed, "headers"))


@query(f"SELECT file_id, concat('Item_', file_id) AS name, 'struct' AS kind, 8 AS start_line FROM (SELECT DISTINCT {FILE_ID} AS file_id FROM part) UNION ALL SELECT file_id, concat('ulong_', file_id), 'typedef', 6 FROM (SELECT DISTINCT {FILE_ID} AS file_id FROM part)")
def types_first_def(spark, sf_dir):
    return graph.first_types(_parts(spark, sf_dir, "types")).select("file_id", "name", "kind", "start_line")


@query(f"SELECT file_id, 'import' AS kind, concat('core.part', file_id) AS target, 4 AS line, concat('import core.part', file_id, ';') AS raw FROM (SELECT DISTINCT {FILE_ID} AS file_id FROM part)")
def module_imports(spark, sf_dir):
    return _parts(spark, sf_dir, "imports")


@query(f"SELECT file_id, unnest([concat('counter_', file_id), concat('total_', file_id)]) AS name, 7 AS line FROM (SELECT DISTINCT {FILE_ID} AS file_id FROM part)")
def global_variables(spark, sf_dir):
    return _parts(spark, sf_dir, "globals").select("file_id", "name", "line")


@query(f"SELECT file_id, unnest(['#include <stdio.h>', '#include <stdlib.h>', concat('#include \"part_', file_id, '.h\"')]) AS header FROM (SELECT DISTINCT {FILE_ID} AS file_id FROM part)")
def headers(spark, sf_dir):
    return _parts(spark, sf_dir, "headers").select("file_id", "header")


_FINDINGS = f"""(SELECT file_id, unnest(list_filter([CASE WHEN k % 5 = 0 THEN concat('malloc in ', id) END, CASE WHEN k % 5 = 0 THEN concat('free in ', id) END, CASE WHEN k % 5 <> 0 THEN concat('printf in ', id) END, CASE WHEN k % 4 <> 0 THEN concat('unprotected raw pointer in ', id) END, concat('NULL macro in ', id)], lambda x: x IS NOT NULL)) AS finding FROM {_FACTS}
    UNION ALL SELECT file_id, unnest([concat('legacy type definition: Item_', file_id), concat('legacy type definition: ulong_', file_id), 'Preprocessor macro usage', 'typedef detected']) FROM (SELECT DISTINCT {FILE_ID} AS file_id FROM part)) f"""


def _analysis(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    parsed = read_once(spark, files, "functions.pos", *P.ANALYZED)
    return P.analyzer_findings(files, graph.last_records(unnest(parsed, "functions")), unnest(parsed, "types")), files


@query(f"SELECT file_id, finding FROM {_FINDINGS}")
def analyzer_findings(spark, sf_dir):
    return _analysis(spark, sf_dir)[0]


@query(f"SELECT file_id, t AS target FROM (SELECT file_id, bool_or(regexp_matches(finding, 'malloc|pointer')) AS m FROM {_FINDINGS} GROUP BY file_id), (VALUES ('memory_management'), ('iostream_upgrade'), ('structural_modernization')) v(t) WHERE m OR t <> 'memory_management'")
def targets(spark, sf_dir):
    return P.targets(*_analysis(spark, sf_dir))


_PLAN = f"""(SELECT file_id, count(*) AS n_findings, bool_or(regexp_matches(finding, 'malloc|free|pointer')) AS memory_modernization, bool_or(NOT contains(finding, 'vector') AND (contains(finding, 'malloc') OR contains(lower(finding), 'array'))) AS container_upgrade,
    bool_or(regexp_matches(finding, 'char\\*|strcpy|strcat') OR contains(lower(finding), 'string')) AS string_modernization, bool_or(regexp_matches(finding, 'time|localtime')) AS chrono_upgrade, bool_or(regexp_matches(finding, 'macro|#define')) AS macro_cleanup, bool_or(regexp_matches(finding, 'typedef|cast')) AS type_safety FROM {_FINDINGS} GROUP BY file_id) p"""
_NFLAGS = "(" + " + ".join(f"{x}::INT" for x in P.FLAGS) + ")"


@query(f"SELECT file_id, {', '.join(P.FLAGS)}, {_NFLAGS} AS n_flags FROM {_PLAN}")
def plan_flags(spark, sf_dir):
    return P.plan(*_analysis(spark, sf_dir)).select("file_id", *P.FLAGS, "n_flags")


@query(f"SELECT file_id, n_findings, round(least(0.05::DOUBLE * n_findings + 0.1::DOUBLE * {_NFLAGS}, 1.0), 6) AS risk_score FROM {_PLAN}")
def plan_risk(spark, sf_dir):
    return P.plan(*_analysis(spark, sf_dir)).select("file_id", "n_findings", "risk_score")


@query(f"SELECT file_id, t AS type, p AS priority FROM {_PLAN}, (VALUES (1, 'raii_migration', 'high'), (2, 'api_upgrade', 'medium'), (3, 'preprocessor_cleanup', 'medium'), (4, 'type_safety_upgrade', 'low')) v(i, t, p) WHERE (i = 1 AND memory_modernization) OR (i = 2 AND chrono_upgrade) OR (i = 3 AND macro_cleanup) OR (i = 4 AND type_safety)")
def plan_transformations(spark, sf_dir):
    return P.plan(*_analysis(spark, sf_dir)).select("file_id", F.explode("transformations").alias("t")).select("file_id", "t.type", "t.priority")


def _versions(spark, sf_dir):
    """Functions before and after, of the part table: some gone, some with another number of parameters, some simpler."""
    p = _t(spark, sf_dir, "part")
    arr = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("name")))
    k = F.col("p_partkey")
    base = p.select((k % 50).alias("file_id"), F.concat(F.lit("fn_"), k.cast("string")).alias("name"), k.alias("pos"), F.concat(F.lit("fn_"), k.cast("string")).alias("unique_fqn"), (k % 4 + 1).alias("n"), F.col("p_size").alias("complexity"))
    before = base.withColumn("parameters", arr(F.col("n")))
    after = base.where("pos % 11 <> 0").withColumn("parameters", arr(F.col("n") + F.when(F.col("pos") % 6 == 0, 1).otherwise(0))).withColumn("complexity", F.when(F.col("pos") % 2 == 0, F.floor(F.col("complexity") / 3)).otherwise(F.col("complexity")))
    return before, after


_REMOVED = "SELECT p_partkey % 50 AS file_id, 'regression' AS category, concat('CRITICAL: Function ''fn_', p_partkey, ''' missing from modernized code.') AS message, 'high' AS severity FROM part WHERE p_partkey % 11 = 0"
_DRIFT = "SELECT p_partkey % 50 AS file_id, 'signature' AS category, concat('WARNING: Parameter count changed in ''fn_', p_partkey, ''' (', p_partkey % 4 + 1, ' -> ', p_partkey % 4 + 2, ')') AS message, 'medium' AS severity FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 11 <> 0"
_LOGIC = "SELECT p_partkey % 50 AS file_id, 'logic_drift' AS category, concat('CAUTION: Potential logic deletion in ''fn_', p_partkey, ''' (complexity dropped ', p_size, ' -> ', p_size // 3, ')') AS message, 'medium' AS severity FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 11 <> 0 AND p_size > 5"


@query(_REMOVED)
def guard_removed(spark, sf_dir):
    return guard.removed_functions(*_versions(spark, sf_dir))


@query(_DRIFT)
def guard_signature_drift(spark, sf_dir):
    return guard.signature_drift(*_versions(spark, sf_dir))


@query(_LOGIC)
def guard_logic_drift(spark, sf_dir):
    return guard.logic_drift(*_versions(spark, sf_dir))


@query(f"SELECT f.file_id, coalesce(n, 0) AS n_issues, NOT coalesce(h, false) AS semantic_ok, round(0.05::DOUBLE * coalesce(n, 0), 6) AS risk_score FROM (SELECT DISTINCT p_partkey % 50 AS file_id FROM part) f LEFT JOIN (SELECT file_id, count(*) AS n, bool_or(severity = 'high') AS h FROM ({_REMOVED} UNION ALL {_DRIFT} UNION ALL {_LOGIC} UNION ALL SELECT DISTINCT p_partkey % 50, 'leak', 'm', 'medium' FROM part WHERE p_partkey % 50 < 10) GROUP BY file_id) i ON f.file_id = i.file_id")
def guard_summary(spark, sf_dir):
    before, after = _versions(spark, sf_dir)
    files = before.select("file_id").distinct().withColumn("text", F.when(F.col("file_id") < 10, "p = malloc(4);").otherwise("int x;"))
    return guard.summary(guard.issues(before, after, files), files)


def _runs(spark, sf_dir):
    e = F.col("event_id")
    after = e % 2 == 1
    return _t(spark, sf_dir, "events").select(
        F.floor(e / 20).alias("pair_id"), F.floor(e % 20 / 2).cast("int").alias("case_index"), F.when(after, "after").otherwise("before").alias("side"), F.lit(True).alias("run_success"),
        F.concat(F.lit("t"), (F.floor(e / 2) % 7).cast("string"), F.when(e % 13 == 0, "!").otherwise("  \r\n\n")).alias("stdout"), F.lit("").alias("stderr"), F.lit(0).alias("exit_code"), (e % 9).cast("int").alias("run_time_ms"), (e % 100).cast("int").alias("peak_memory_kb"),
        F.when(after & (e % 31 == 0), F.array(F.lit("ERROR: leak"))).otherwise(F.array().cast("array<string>")).alias("sanitizer_findings"),
    )


_CASES = "(SELECT event_id // 20 AS pair_id, (event_id % 20) // 2 AS case_index, count(*) = 2 AND NOT bool_or(event_id % 13 = 0) AND NOT bool_or(event_id % 2 = 1 AND event_id % 31 = 0) AS same, sum(CASE WHEN event_id % 2 = 0 THEN event_id % 9 END) AS b, sum(CASE WHEN event_id % 2 = 1 THEN event_id % 9 END) AS a, max(CASE WHEN event_id % 2 = 1 THEN event_id % 100 END) AS am, max(CASE WHEN event_id % 2 = 0 THEN event_id % 100 END) AS bm, sum(CASE WHEN event_id % 2 = 1 AND event_id % 31 = 0 THEN 1 ELSE 0 END) AS nf FROM events GROUP BY ALL) c"


@query(f"SELECT pair_id, case_index, same FROM {_CASES}")
def parity_cases(spark, sf_dir):
    return parity.cases(_runs(spark, sf_dir)).select("pair_id", F.col("case_index").cast("long").alias("case_index"), "same")


@query(f"WITH x AS (SELECT *, min(CASE WHEN NOT same THEN case_index END) OVER (PARTITION BY pair_id) AS first FROM {_CASES}) SELECT pair_id, min(first) IS NULL AS parity, min(first) AS first_failure, count(*) AS cases_run, CAST(sum(b) AS BIGINT) AS before_ms, CAST(sum(a) AS BIGINT) AS after_ms, max(am) - max(bm) AS memory_delta_kb, CAST(sum(nf) AS BIGINT) AS n_findings FROM x WHERE first IS NULL OR case_index <= first GROUP BY pair_id")
def parity_first_failure(spark, sf_dir):
    d = parity.differential(_runs(spark, sf_dir))
    return d.select("pair_id", "parity", F.col("first_failure").cast("long").alias("first_failure"), "cases_run", "before_ms", "after_ms", F.col("memory_delta_kb").cast("long").alias("memory_delta_kb"), F.size("sanitizer_findings").cast("long").alias("n_findings"))


_STATES = "SELECT s AS success, o AS semantic_ok, a AS attempts, e AS error_log FROM (VALUES (true), (false)) x(s), (VALUES (true), (false)) y(o), (VALUES (1), (2), (3)) z(a), (VALUES (''), ('warning: x')) w(e)"


@query(f"SELECT *, CASE WHEN success AND semantic_ok THEN 'end' WHEN attempts >= 3 THEN 'end' WHEN error_log <> '' THEN 'fixer' WHEN NOT semantic_ok THEN 'planner' ELSE 'modernizer' END AS next FROM ({_STATES})")
def router(spark, sf_dir):
    s = spark.sql(_STATES)
    return s.withColumn("next", P.route(F.col("success"), F.col("semantic_ok"), F.col("attempts"), F.lit(3), F.col("error_log")))


@query(f"SELECT *, CASE WHEN score >= 0.9 THEN 'EXCEPTIONAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW (MANUAL REVIEW REQUIRED)' END AS rating FROM (SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE least(0.95, CASE WHEN o_orderstatus = 'F' THEN 0.8::DOUBLE ELSE 0.2 END + CASE WHEN o_custkey % 2 = 0 THEN 0.2::DOUBLE ELSE 0.05 END) END, 6) AS score FROM orders)")
def score_rating(spark, sf_dir):
    s = F.round(P.score(F.col("o_orderkey") % 5, F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0), 6)
    return _t(spark, sf_dir, "orders").select("o_orderkey", s.alias("score"), P.rating(s).alias("rating"))


@query("SELECT user_id AS key, max(event_id) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, key LIMIT 50")
def lru_keep(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("last_used"))
    return parity.keep_recent(e, 50).select("key", "last_used")


@query(f"WITH w AS (SELECT DISTINCT file_id, unnest([3 + file_id // {FILE} % 5, 9, 14]) AS e FROM (SELECT {FILE_ID} AS file_id FROM part)) SELECT l.file_id, CAST(w.e AS INT) AS error_line, l.line, l.line_text AS text FROM {_LINES} l JOIN w ON w.file_id = l.file_id AND abs(l.line - w.e) <= 2")
def error_context(spark, sf_dir):
    """Errors differ by file; the fourth line and the second note of one line don't count."""
    files = code_corpus(spark, sf_dir)
    low = (3 + F.floor(F.col("file_id") / FILE) % 5).cast("string")
    text = F.concat(F.lit("a.cpp:9:1: error: x\na.cpp:20:1: error: x\na.cpp:"), low, F.lit(":7: error: y\na.cpp:9:2: note: z\nb.cpp:14: error"))
    c = patterns.error_context(files.select("file_id", text.alias("error_text")), files)
    return c.select("file_id", F.col("error_line").cast("int").alias("error_line"), F.col("line").cast("long").alias("line"), "text")


@query("SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN concat(left(text, 200 - 15), chr(10), '...<truncated>') ELSE text END) AS out_md5 FROM documents")
def truncate_output(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncate_output(F.col("text"), 200)).alias("out_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: rtrim(x, chr(9) || chr(11) || chr(12) || ' ')), chr(10)), '\n+$', '')) AS out_md5 FROM documents")
def normalize_output(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_output(F.col("text"))).alias("out_md5"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 5 = 0 THEN 'Process crashed (detected from stderr).' WHEN event_id % 3 = 0 THEN 'execution_error' WHEN event_id % 4 = 0 THEN concat('Process terminated by signal ', event_id % 15 + 1, ' (platform-dependent).') WHEN event_id % 2 = 0 THEN concat('Process exited with non-zero status ', event_id % 15 + 1, '.') ELSE '' END AS reason FROM events")
def crash_reason(spark, sf_dir):
    e = F.col("event_id")
    code = F.when(e % 3 == 0, None).when(e % 4 == 0, -(e % 15 + 1)).when(e % 2 == 0, e % 15 + 1).otherwise(0)
    return _t(spark, sf_dir, "events").select("event_id", T.crash_reason(code, F.when(e % 5 == 0, "x: Segmentation fault (core dumped)"), e % 7 == 0).alias("reason"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN greatest(1, event_id * 100 // 1024) END AS peak_kb FROM events")
def peak_memory(spark, sf_dir):
    e = F.col("event_id")
    err = F.when(e % 3 == 0, F.concat(F.lit("  Maximum resident set size (kbytes): "), e.cast("string"))).when(e % 3 == 1, F.concat((e * 100).cast("string"), F.lit(" byte(s) allocated")))
    return _t(spark, sf_dir, "events").select("event_id", T.peak_memory_kb(err).alias("peak_kb"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '==1==ERROR: AddressSanitizer: x' WHEN event_id % 4 = 1 THEN 'SUMMARY: leaksanitizer' ELSE '' END AS found FROM events")
def sanitizer_lines(spark, sf_dir):
    e = F.col("event_id")
    err = F.concat(F.lit("warning\n  "), F.when(e % 4 == 0, "==1==ERROR: AddressSanitizer: x  ").when(e % 4 == 1, "SUMMARY: leaksanitizer").otherwise("fine"), F.lit("\nend"))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(T.sanitizer_lines(err), ",").alias("found"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'int main() { return 0; }' WHEN event_id % 4 = 1 THEN '#include <a>' || chr(10) || 'f(x);' WHEN event_id % 4 = 2 THEN 'struct A {};' ELSE 'no code' END AS code FROM events")
def best_block(spark, sf_dir):
    e, f = F.col("event_id"), "```"
    text = F.when(e % 4 == 0, f"a\n{f}cpp\n#include <x>\n#include <y>\nclass Z;\n{f}\nb\n{f}\nint main() {{ return 0; }}\n{f}").when(e % 4 == 1, f"{f}cpp\nf(x);\n{f}\n{f}CPP\n#include <a>\nf(x);\n{f}").when(e % 4 == 2, f"{f}c++\nstruct A {{}};\n{f}").otherwise("  no code\n")
    return _t(spark, sf_dir, "events").select("event_id", T.best_block(text).alias("code"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('src/f', o_orderkey, '_modernized.cpp') ELSE concat('src/f.', o_orderkey, '_modernized.cpp') END AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 3 = 1 THEN 'old' ELSE '// empty' END AS text FROM orders")
def output_files(spark, sf_dir):
    k = F.col("o_orderkey")
    r = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, F.concat(F.lit("src/f"), k.cast("string"), F.lit("_modernized.cpp"))).otherwise(F.concat(F.lit("src/f."), k.cast("string"), F.lit(".cpp"))).alias("path"), F.when(k % 3 == 1, "old").alias("text"), F.when(k % 3 == 0, "new").otherwise(" \n").alias("new_text"))
    return r.select("o_orderkey", T.output_path(F.col("path")).alias("path"), T.output_text(F.col("new_text"), F.col("text")).alias("text"))


@query(f"SELECT f.file_id, f.id, coalesce(e.dst, '') AS callees, '' AS types, regexp_extract({_CODE.replace('p_partkey', 'f.k')}, '(?s)[)] ([{{]\n.*[}}])\n\n$', 1) AS body FROM (SELECT t.*, p_name FROM {_FACTS} JOIN part ON p_partkey = t.k) f LEFT JOIN {_EDGES} ON e.file_id = f.file_id AND e.src = f.id")
def function_context(spark, sf_dir):
    parsed = read_once(spark, code_corpus(spark, sf_dir), *graph.CONTEXT)
    f = unnest(parsed, "functions")
    c = graph.function_context(f, call_table(f), unnest(parsed, "types"))
    names = lambda col, x: F.coalesce(F.array_join(F.transform(col, lambda y: y[x]), ","), F.lit(""))
    return c.select("file_id", "id", names("callee_signatures", "dst").alias("callees"), names("type_sources", "name").alias("types"), "body")


@query(f"SELECT f.file_id, f.id AS unique_fqn, coalesce(e.dst, '') AS internal_calls, CASE WHEN k % 5 = 0 THEN 'free,malloc' ELSE 'printf' END AS external_calls FROM {_FACTS.replace(') t', ')')} f LEFT JOIN {_EDGES} ON e.file_id = f.file_id AND e.src = f.id")
def function_map(spark, sf_dir):
    f = unnest(read_once(spark, code_corpus(spark, sf_dir)), "functions")
    m = graph.function_map(f, call_table(f))
    return m.select("file_id", "unique_fqn", F.array_join("internal_calls", ",").alias("internal_calls"), F.array_join("external_calls", ",").alias("external_calls"))


@query(f"WITH RECURSIVE e AS (SELECT {FILE_ID} AS file_id, p_partkey AS s, p_partkey - 7 AS d FROM part WHERE {_CALLS}), r AS (SELECT file_id, s, d FROM e UNION SELECT r.file_id, r.s, e.d FROM r JOIN e ON e.s = r.d AND e.file_id = r.file_id) SELECT file_id, concat('fn_', s) AS src, concat('fn_', d) AS dst FROM r")
def call_closure(spark, sf_dir):
    c = graph.call_closure(graph.edges(graph.resolved_calls(extract(code_corpus(spark, sf_dir), only=graph.CALLS))))
    name = lambda x: F.substring_index(x, "#", 1).alias(x)
    return c.select("file_id", name("src"), name("dst")).distinct()


@query(f"SELECT file_id, n_findings, round(least(0.05::DOUBLE * n_findings + 0.1::DOUBLE * {_NFLAGS}, 1.0), 6) AS risk_score, 2 * bool_or_malloc::INT AS n_issues, true AS semantic_ok, 1 AS attempts, 0.95::DOUBLE AS score, 'EXCEPTIONAL' AS rating, md5({_REWRITTEN}) AS text_md5 FROM {_PLAN} JOIN (SELECT file_id AS fid, text, contains(text, 'malloc') AS bool_or_malloc FROM {_CORPUS} c) ON fid = file_id")
def modernized(spark, sf_dir):
    m = modernize(code_corpus(spark, sf_dir))
    return m.select("file_id", "n_findings", "risk_score", F.col("n_issues").cast("int").alias("n_issues"), "semantic_ok", "attempts", "score", "rating", F.md5("new_text").alias("text_md5"))


_queries.update(unit_queries.QUERIES | flow_queries.QUERIES | {"output_diff": unit_queries.output_diff})
_oracle.update(unit_queries.ORACLE | flow_queries.ORACLE | {"output_diff": unit_queries.diff_sql(_CORPUS, _REWRITTEN)})


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
