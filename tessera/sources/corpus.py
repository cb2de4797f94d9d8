"""A corpus of code made from the part table by one SQL expression, which reads the same in other SQL engines. What each
function holds follows from its key, so facts about the corpus are known without reading it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Functions to a file.
FILE = 40

KEY = "p_partkey"
FILE_ID = f"(p_partkey - p_partkey % {FILE})"
FUNCTION = f"""concat(
    CASE WHEN p_partkey % {FILE} = 0 THEN concat('#include <stdio.h>', chr(10), '#include <stdlib.h>', chr(10), '#include "part_', p_partkey, '.h"', chr(10), 'import core.part', p_partkey, ';', chr(10),
        '#define LIMIT_', p_partkey, ' 10', chr(10), 'typedef unsigned long ulong_', p_partkey, ';', chr(10), 'int counter_', p_partkey, ' = 0, total_', p_partkey, ';', chr(10), 'struct Item_', p_partkey, ' ', '{{', ' int id; ', '}}', ';', chr(10), chr(10)) ELSE '' END,
    '/* part ', p_partkey, ' */', chr(10), 'static int fn_', p_partkey, '(',
    CASE WHEN p_partkey % 4 = 0 THEN 'const char *arg, int n' WHEN p_partkey % 4 = 1 THEN 'char *arg' ELSE 'int n' END, ') ', '{{', chr(10),
    CASE WHEN p_partkey % 3 = 0 THEN concat('    if (arg == NULL) ', '{{', ' return 0; ', '}}') ELSE '    // NULL is checked by the caller' END, chr(10),
    CASE WHEN p_partkey % 5 = 0 THEN '    int *buf = (int *)malloc(16); free(buf);' ELSE concat('    printf("', regexp_replace(p_name, '[^A-Za-z0-9 ]', '_'), '");') END, chr(10),
    CASE WHEN p_partkey % 7 = 0 THEN concat('    for (int i = 0; i < 3; i++) ', '{{', ' std::vector<int> v; ', '}}', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % {FILE} >= 7 THEN concat('    return fn_', p_partkey - 7, '(0);') ELSE '    return 0;' END, chr(10), '}}', chr(10), chr(10))""".replace("{{", "{").replace("}}", "}")


def code_corpus(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """file_id, path, text: a file for each FILE parts, in key order."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where(where)
    part.createOrReplaceTempView("tessera_part")
    return spark.sql(f"""SELECT file_id, concat('src/', file_id, '.cpp') AS path, array_join(transform(array_sort(collect_list(struct(k, x))), y -> y.x), '') AS text
        FROM (SELECT {FILE_ID} AS file_id, {KEY} AS k, {FUNCTION} AS x FROM tessera_part) GROUP BY file_id""")


def corpus_sql(where: str = "true") -> str:
    """The same for DuckDB, as a subquery."""
    f = FUNCTION.replace("'[^A-Za-z0-9 ]', '_')", "'[^A-Za-z0-9 ]', '_', 'g')")
    return f"(SELECT file_id, concat('src/', file_id, '.cpp') AS path, string_agg(x, '' ORDER BY k) AS text FROM (SELECT {FILE_ID} AS file_id, {KEY} AS k, {f} AS x FROM part WHERE {where}) t GROUP BY file_id)"
