"""What must not grow with the tables: what a worker holds, and how much one task does."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import extract as X
from tessera.operators.lexer import tokens
from tessera.sources import dialect as D
from tessera.sources import units as U

SF = "/root/testdata/sf0.01"


def test_many_files_are_many_tasks(spark):
    tasks = U.unit_corpus(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism
    assert U.tasks(spark, 10_000_000) == 10_000_000 // U.FILES


def test_a_batch_leaves_the_worker_in_parts():
    texts = ["int f() { return 1; }"] * 700 + ["x" * X.PART_BYTES, None, "int g;"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["file_id", "text"])
    parts = list(X._parts(batch))
    assert [p.num_rows for p in parts] == [256, 256, 189, 2]
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert not list(X._parts(batch.slice(0, 0)))


def test_a_reading_leaves_out_what_is_not_asked_for(spark):
    files = spark.createDataFrame([(1, U.UNIT), (2, D.DIALECT), (3, None)], "file_id long, text string")
    every = {r.file_id: r for r in X.extract(files).collect()}
    for only in (("types",), ("functions.name", "types.fqn"), ("functions.call_details",), ("functions.complexity", "casts"), ("imports",), ("headers", "globals.name"), ("parse_warning",)):
        got = X.extract(files, only=only)
        for r in got.collect():
            for c in got.columns[1:]:
                names = got.schema[c].dataType.elementType.names if c != "parse_warning" else []
                want = every[r.file_id][c]
                assert r[c] == ([tuple(x[n] for n in names) for x in want] if names else want)
    with pytest.raises(ValueError):
        X.extract(files, only=("functions.no",))


def test_blanks_are_read_once():
    n = 300_000
    assert [x.text for x in tokens("a" + "\n" * n + " #if x\n" + " " * n)] == ["a", " #if x"]
    assert [x.text for x in tokens("a\n \f #b\n\t#c")] == ["a", "#", "b", "\t#c"]


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    from tessera.sources.scratch import _CLEANUP, Scratch

    before = spark.conf.get(_CLEANUP)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {x.rsplit("/", 1)[-1] for x in local.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    had = names()
    Scratch(spark, "t").write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "x")
    for _ in range(50):
        if names() <= had:
            break
        time.sleep(0.1)
    assert names() <= had
    assert spark.conf.get(_CLEANUP) == before


def test_a_table_in_parts_is_listed_as_one(spark, tmp_path):
    from tessera.unit_queries import _TABLES, directory

    for i, t in enumerate(_TABLES):
        (tmp_path / f"{t}.parquet").mkdir() if i % 2 else (tmp_path / f"{t}.parquet").touch()
    got = directory(spark, str(tmp_path)).collect()
    assert [(r.position, r.name, r.type) for r in got] == [(i + 1, f"{t}.parquet", "file") for i, t in enumerate(_TABLES)]


def test_each_round_is_dealt_by_files(spark, monkeypatch):
    from tessera.plans import workflow as W

    tasks = []

    def counted(f):
        def run(files, *a, **k):
            tasks.append(files.select(F.spark_partition_id()).distinct().count())
            return f(files, *a, **k)

        return run

    monkeypatch.setattr(W, "extract", counted(W.extract))
    monkeypatch.setattr(W, "apply_rules", counted(W.apply_rules))
    assert W.modernize(U.unit_corpus(spark, SF), lambda t, plan: t, None, 1, planned=True).where("success").count() == 1500
    # The reading, the rules before and after the rewriter, and the reading of what was written.
    assert len(tasks) == 4 and min(tasks) >= U.tasks(spark, 1500) - 2


def test_waves_find_what_they_ask_once(spark, tmp_path):
    from tessera.plans.answers import Answers

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    prompts = spark.range(40).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("q")).coalesce(1).mapInArrow(count, "key string, q string")
    said = Answers(spark, str(tmp_path / "a"), wave=4).ask(prompts, lambda q: f"{q}!")
    # To count them, and to write them by wave; not ten waves more.
    assert 40 <= seen.value <= 80
    assert {r.key: r.answer for r in said.collect()} == {str(i): f"{i}!" for i in range(40)}


def test_postings_are_rows_of_a_part():
    from tessera.operators.search_index import _postings

    texts = ["abcabc", None, "xbc", "abc", "", "bca"]
    batch = pa.record_batch([pa.array(range(6), pa.int64()), pa.array([0, 0, 0, 1, 1, 1], pa.int32()), pa.array(texts)], ["file_id", "part", "text"])
    rows = [(r["gram"].to_bytes(3, "big").decode(), r["part"], r["files"]) for b in _postings([batch.slice(0, 2), batch.slice(2)]) for r in b.to_pylist()]
    assert rows == [("abc", 0, [0]), ("bca", 0, [0]), ("cab", 0, [0]), ("xbc", 0, [2]), ("abc", 1, [3]), ("bca", 1, [5])]


def test_of_a_function_only_what_is_told_is_made():
    for text in (U.UNIT, D.DIALECT):
        every = X.read_text(text)["functions"]
        for told in ({"fqn"}, {"unique_fqn", "call_details"}, {"pos", "body"}, {"modifiers", "function_hash"}, {"complexity", "legacy_patterns"}):
            got = X.read_text(text, None, {"functions"}, frozenset(told))["functions"]
            assert [{k: f[k] for k in told} for f in got] == [{k: f[k] for k in told} for f in every]
            assert all(("body" in f) == bool(told & X._OF_TEXT) and ("complexity" in f) == bool(told & X._OF_CALLS) for f in got)


def test_pieces_tell_their_places():
    text = 'a /* é */ R"x(")x" u\'c\' \n#if 1\n \f #b ~c .5f \x1c::u8v // d\n'
    got = tokens(text)
    assert [(x.kind, x.text) for x in got] == [("name", "a"), ("string", 'R"x(")x"'), ("string", "u'c'"), ("pp", "#if 1"), ("op", "#"), ("name", "b"), ("name", "~c"), ("number", ".5f"), ("op", "::"), ("name", "u8v")]
    assert all(text[x.start : x.end] == x.text for x in got)


def test_texts_stay_where_they_are_if_candidates_are_few(spark, tmp_path, monkeypatch):
    from tessera.operators import search_index as I

    files = spark.range(600).select(F.col("id").alias("file_id"), F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("needle "), "id").alias("text"))
    index = I.SearchIndex(spark, str(tmp_path / "i")).build(files, 50)
    for few, joined in ((I.FEW, "broadcast"), (5, "")):
        monkeypatch.setattr(I, "FEW", few)
        plan = index.files("needle")._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == bool(joined)
        assert index.search("needle 1.").count() == 110


def test_a_reading_makes_no_object_a_token(monkeypatch):
    from tessera.operators import lexer as L

    made = []
    monkeypatch.setattr(L, "Token", lambda *a: made.append(a))
    assert len(X.read_text(U.UNIT.replace("@", "7"))["functions"]) == len(U.FUNCTIONS) and not made
    c = L.columns("int a; // b\n  #if x\n")
    assert (c.said, c.kinds, c.starts, c.ends) == (["int", "a", ";", "  #if x"], ["name", "name", "op", "pp"], [0, 4, 5, 12], [3, 5, 6, 19])


def test_a_round_reads_and_rules_only_what_is_new(spark, monkeypatch):
    from tessera.plans import workflow as W
    from tessera.unit_queries import _breaks, _compiles, _mends

    seen = {"extract": [], "apply_rules": []}

    def counted(name, f):
        def run(files, *a, **k):
            seen[name].append(files.count())
            return f(files, *a, **k)

        return run

    for name in seen:
        monkeypatch.setattr(W, name, counted(name, getattr(W, name)))
    files = U.unit_corpus(spark, "/root/testdata/sf0.001").where("file_id <= 30")
    n, keys = files.count(), [r.file_id for r in files.select("file_id").collect()]
    dropped, mended = sum(k % 5 == 4 for k in keys), sum(k % 5 != 4 and k % 3 == 1 for k in keys)
    rows = {r.file_id: r for r in W.modernize(files, _breaks, _compiles, 3, _mends, planned=True).collect()}
    # All, what is new of them, what the fixer mended, and nothing: what is told of a text that stays is kept.
    assert seen["extract"] == [n, n, mended, 0]
    assert seen["apply_rules"] == [n, n, dropped, dropped]
    assert {k: (r.attempts, r.semantic_ok, r.success) for k, r in rows.items()} == {k: (3 if k % 5 == 4 or k % 3 == 2 else 2 if k % 3 == 1 else 1, k % 5 != 4, k % 5 == 4 or k % 3 != 2) for k in keys}
    assert all((r.n_issues > 1 and r.issues[0].category) == "leak" or any(x.category == "regression" for x in r.issues) for k, r in rows.items() if k % 5 == 4)


def test_issues_are_those_of_each_kind(spark):
    from tessera.operators import guard

    schema = "file_id long, pos int, unique_fqn string, name string, parameters array<string>, complexity int"
    before = [(1, 0, "f#1", "f", ["a"], 9), (1, 5, "f#2", "f", [], 2), (1, 9, "g#1", "g", [], 6), (1, 12, "h#1", None, [], 6), (2, 0, "k#1", "k", ["a", "b"], 7), (3, 0, "x#1", "x", [], 1)]
    after = [(1, 0, "f#2", "f", [], 2), (1, 3, "f#3", "f", ["a"], 4), (1, 9, "h#1", None, [], 0), (2, 0, "k#1", "k", ["a"], 4), (4, 0, "n#1", "n", [], 1)]
    b, a = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    files = spark.createDataFrame([(1, "free(p)"), (2, "int k;"), (3, " \n")], "file_id long, text string")
    want = guard.removed_functions(b, a).union(guard.signature_drift(b, a)).union(guard.logic_drift(b, a)).union(guard.leaks(files)).where("file_id <> 3")
    got = guard.issues(b, a, files)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7
    # One exchange of both versions, no window.
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_rule_is_searched_by_its_first_word():
    import re

    from tessera.operators.rules import RULES, headed

    assert headed(r"\bNULL\b") == r"NULL(?<=\bNULL)\b" and headed(r"\ba\b|\bbc\b") == r"a(?<=\ba)\b|bc(?<=\bbc)\b"
    assert all(headed(x) == x for x in (r"\bab?\b", r"\babc*", r"\bx{2}", r"\bab(?:c|d)|e", r"#\s*a", r"\bab|c"))
    text = U.UNIT + " NULLx xNULL _NULL NULL* std ::auto_ptr xstd::auto_ptr char*p achar *q char * é1 éNULL time_tx localtime printf (x) sprintf(x) mymalloc(1) malloc\n(2) throw  ( ) rethrow()"
    for r in RULES:
        assert [m.span() for m in r.compiled.finditer(text)] == [m.span() for m in re.finditer(r.linear or r.regex, text, re.M)]


def test_many_searches_read_the_texts_once(spark, tmp_path):
    from tessera.flow_queries import QUERIES
    from tessera.operators.search_index import SearchIndex

    rows = [(i, f"p/{i}", f"key {i}\r\n token=abc{i % 3}\nxxxx\n\n") for i in range(40)] + [(98, "build/x", "xxx"), (99, None, None), (100, "e", "")]
    index = SearchIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame(rows, "file_id long, path string, text string"), 8)
    for asked in (("x{3}", r"\d\d", "token=abc1", "abc[02]", "zzzz", "^$"), ("xxxx", "abc2", "nowhere"), (r"\d9",)):
        want = [(i, r.path, r.line, r.text) for i, e in enumerate(asked) for r in index.search(e).collect()]
        got = index.search_for(asked)
        assert sorted(map(str, got.select("expression", "path", "line", "text").toLocalIterator())) == sorted(str(spark_row(x)) for x in want) and len(want) >= 3
        assert got._jdf.queryExecution().optimizedPlan().toString().count("/i/texts") <= 1
    plan = QUERIES["indexed_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1


def test_an_expression_is_tried_where_its_strings_are():
    from tessera.operators.search_index import literals

    assert literals("ción.*ción.*ciónción") == ("ción", "ciónción") and literals(r"\+1 \(\d{3}\) 555-\d{4}") == ("+1 (", ") 555-")
    assert literals("(abc|d)efg") == ("efg",) and literals("abcd?") == ("abc",) and literals("(?:abc)*") == ()
    for e in ("(?i)abc", "(?x)a b c", r"\Qabc", "abc&&d", "(?i:abc)", "abc|def", "[abc]d", "("):
        assert literals(e) == ()


def spark_row(x):
    from pyspark.sql import Row

    return Row(expression=x[0], path=x[1], line=x[2], text=x[3])
