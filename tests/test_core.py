"""Units of the reading, rewriting, graph and text functions."""

import json
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import native, tools
from tessera.functions import text as T
from tessera.functions.regexops import mask, matches
from tessera.operators import graph, guard, parity, patterns
from tessera.operators.extract import call_table, extract, read_text, token_table, unnest
from tessera.operators.rules import RULES, apply_rule, edits, masked, modernize_text
from tessera.plans.bridge import Bridge
from tessera.plans.workflow import lite, modernize
from tessera.sources import files as S
from tessera.sources.config import Settings, read_bool, read_int

CODE = """#include <stdio.h>
#include "a.h"
import <vector>;
namespace ns { class Foo : public Base, private ns::Other { int x; public: Foo(int a) : x(a) {} ~Foo() {} int get() const { return x; } };
template <typename T> static inline T add(T a, const std::vector<int>& v, int d = 3) { return a + v.size(); } }
// doc

/* more */
int ns::Foo::run(char *p, int n) {
  for (;;) { if (n) break; }
  (*fp)(1); arr[i](2); obj.m(); ns::g(); [](){ }(); std::vector<int> z(3); char *q = (char *)malloc(4);
  make<int>(3); return n ? add(1, {}) : 0;
}
typedef struct { int id; } Item;
typedef unsigned long ulong;
using X = int;
enum class Color { Red };
int a = 1, b;
int f(void);
void g(std::string s, ...) { NULL; }
"""


def _one(code):
    return {f["fqn"]: f for f in read_text(code)["functions"]}


def test_functions():
    f = _one(CODE)
    assert list(f) == ["ns::Foo::Foo", "ns::Foo::~Foo", "ns::Foo::get", "ns::add", "ns::Foo::run", "g"]
    run = f["ns::Foo::run"]
    assert run["start_line"] == 6 and run["legacy_patterns"]["has_malloc"] and not run["legacy_patterns"]["has_null_macro"]
    assert [(c["name"], c["kind"]) for c in run["call_details"]] == [("fp", "function_pointer"), ("arr", "functor"), ("m", "method"), ("g", "scoped"), ("<lambda>", "lambda"), ("malloc", "local"), ("make", "local"), ("add", "local")]
    assert f["ns::add"]["is_template"] and f["ns::add"]["modifiers"] == ["static", "inline"]
    # A parameter with a default is not told.
    assert [(p["name"], p["type"], p["is_reference"], p["is_const"]) for p in f["ns::add"]["parameters"]] == [("a", "T", False, False), ("v", "const std::vector<int>", True, True)]
    assert f["g"]["name"] == "g" and f["g"]["parameters"][0]["type"] == "std::string"


def test_declarations():
    r = read_text(CODE)
    assert [(t["fqn"], t["kind"]) for t in r["types"]] == [("ns::Foo", "class"), ("Item", "typedef"), ("ulong", "typedef"), ("X", "type_alias"), ("Color", "enum")]
    assert r["types"][0]["bases"] == ["Base", "ns::Other"]
    assert [g["name"] for g in r["globals"]] == ["a", "b"] and [h["header"] for h in r["headers"]] == ["#include <stdio.h>", '#include "a.h"']
    assert [c["match"] for c in r["casts"]] == ["(char *)malloc(4)"] and r["parse_warning"] is None


@pytest.mark.parametrize("code", ["", "   \n", "int x;", "void f() {", "}}}", "void f() { (", '"', "/*", "#define A {\nint f() { return 1; }", "é void f(int é) {}"])
def test_odd_texts(code):
    r = read_text(code)
    assert isinstance(r["functions"], list)


def test_ids_collide_and_bytes(spark):
    code = "// é\nint f(int a) { return 1; }\nint f(int *a) { return 2; }\n"
    files = spark.createDataFrame([(1, code), (2, None)], "file_id long, text string")
    f = unnest(extract(files), "functions")
    last = graph.last_records(f).collect()
    assert len(last) == 1 and last[0].id_collision and "return 2" in last[0].body
    assert f.where("pos = 0").first().end_byte == len("// é\nint f(int a) { return 1; }".encode())


def test_call_tiers(spark):
    """Self calls of an overload don't fall through to other tiers; a display with :: is looked up whole."""
    code = "namespace a { int f(int x) { return f(x) + g(1); } int g(int x) { return b::g(2); } }\nnamespace b { int g(int x) { return a::f(1) + zz(); } }"
    f = unnest(extract(spark.createDataFrame([(1, code)], "file_id long, text string")), "functions")
    r = graph.resolve_calls(call_table(f), f)
    e = {(x.src.split("#")[0], x.dst.split("#")[0]) for x in graph.edges(r).collect()}
    assert e == {("a::f", "a::g"), ("a::f", "b::g"), ("a::g", "b::g"), ("b::g", "a::f")}
    assert [x.display for x in graph.external_calls(r).collect()] == ["zz"]
    d = graph.degrees(f.select("file_id", F.col("unique_fqn").alias("id")), graph.edges(r)).collect()
    assert sum(x.n_in for x in d) == sum(x.n_out for x in d) == 4
    order = graph.priority_order(graph.degrees(f.select("file_id", F.col("unique_fqn").alias("id")), graph.edges(r))).collect()
    assert sorted(x.position for x in order) == [1, 2, 3]


def test_ambiguous_lookup(spark):
    code = "int f(int a) { return 1; }\nint f(char a) { return 2; }\nint g() { return 0; }"
    f = unnest(extract(spark.createDataFrame([(1, code)], "file_id long, text string")), "functions")
    assert graph.lookup_function(f, 1, "g").count() == 1
    with pytest.raises(Exception, match="ambiguous"):
        graph.lookup_function(f, 1, "f").collect()


def test_rules():
    code = '#include <stdio.h>\n#define MAX 10\ntypedef int num; // note\nvoid f() throw() { p = NULL; /* NULL */ s = "NULL"; }\nx();\nx();\nputs("a");\nputs("b");\n'
    new, applied = modernize_text(code)
    assert "#include <cstdio>" in new and "constexpr auto MAX = 10;" in new and "using num = int; // note" in new
    assert 'p = nullptr; /* NULL */ s = "NULL";' in new and "noexcept" in new
    assert new.count("x();") == 1 and 'puts("a");' in new and 'puts("b");' in new
    assert dict(applied)["NULL -> nullptr"] == 1
    assert modernize_text(code, patterns={"malloc_usage": 1})[0].count("NULL") == 3
    again, _ = modernize_text(new)
    assert again == new


@given(st.text(alphabet='ab/*"\'\\\n NUL', max_size=60))
@settings(max_examples=200, deadline=None)
def test_mask_keeps_shape(text):
    m = masked(text)
    assert len(m) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(m) if c == "\n"]
    apply_rule(text, RULES[0])


def test_mask_column(spark):
    rows = ["", 'a "b\\"c" // d\n\'x\' /* e\nf */ g', "1'000", '"' + "x" * 20000 + '"', "/*" + "y" * 240000 + "*/ z", "a / b", '"open']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select("i", mask(F.col("t")).alias("m")).orderBy("i").collect()
    assert [g.m for g in got] == [masked(x) for x in rows]


def test_matches(spark):
    got = spark.createDataFrame([("NULL\n\nx NULL NULL\n",), ("",), (None,)], "t string").select(matches(F.col("t"), r"\bNULL\b").alias("m")).collect()
    assert [[(x.line, x.match) for x in g.m] if g.m else g.m for g in got] == [[(1, "NULL"), (3, "NULL"), (3, "NULL")], [], None]


def test_search(spark):
    files = spark.createDataFrame([("a/x.c", "foo\nbar"), ("build/y.c", "foo"), ("b.c", "foo"), ("c.c", "foo")], "path string, text string")
    assert {(r.path, r.line) for r in patterns.search_lines(files, "fo+").collect()} == {("a/x.c", 1), ("b.c", 1), ("c.c", 1)}
    assert {r.path for r in patterns.search_code(files, "foo", 1).collect()} == {"a/x.c", "b.c"}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(T.fenced_code(lit("a ```cpp\nint x;\n``` b"))) == "int x;" and one(T.fenced_code(lit(" y "))) == "y"
    assert one(T.plausible_code(lit("int main() { return 0; }"))) and not one(T.plausible_code(lit("short;")))
    assert one(T.valid_code(lit("int main() { return 0; }"))) and not one(T.valid_code(lit("NO_CHANGE")))
    assert one(T.error_location(lit("x\n  a.cpp:3: bad \n"), lit("a.cpp"))) == "a.cpp:3: bad"
    assert one(T.normalize_output(lit("a \r\nb\t\r\n\n\n"))) == "a\nb"


def test_guard_and_workflow(spark):
    code = 'int f(int a) { int *p = (int *)malloc(4); printf("x"); return a == NULL; }\n'
    files = spark.createDataFrame([(1, code), (2, "")], "file_id long, text string")
    out = {r.file_id: r for r in modernize(files).collect()}
    assert "nullptr" in out[1].new_text and out[1].semantic_ok and out[1].attempts == 1 and out[2].semantic_ok
    # A rewriter that drops the function is found out, tried again and given up.
    bad = {r.file_id: r for r in modernize(files, rewriter=lambda t: "int other() { return 1; }", max_attempts=2).collect()}
    assert not bad[1].semantic_ok and bad[1].attempts == 2
    assert lite(files, lambda t: t.replace("f(", "h(")).where("text like '%h(int%'").count() == 1
    before = unnest(extract(files), "functions")
    assert guard.removed_functions(before, before.where("false")).count() == 1


def test_parity_diff_cache(spark):
    d = parity.output_diff(spark.createDataFrame([(1, "a\nb", "a\nc")], "id long, before string, after string")).first().diff
    assert "-b" in d and "+c" in d
    e = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3), ("c", 4, 4)], "key string, value int, last_used int")
    assert {(r.key, r.value) for r in parity.keep_recent(e, 2).collect()} == {("a", 3), ("c", 4)}


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.cpp").write_text("int f() { return 1; }\n")
    (tmp_path / "s" / "b.txt").write_text("no")
    assert S.read_sources(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        S.read_source(spark, str(tmp_path / "none.cpp"))
    with pytest.raises(PermissionError):
        S.safe_path("../x", str(tmp_path))
    assert [(r.name, r.type) for r in S.list_directory(spark, "s", str(tmp_path)).collect()] == [("a.cpp", "file"), ("b.txt", "file")]
    assert '"bytes_written": 2' in S.write_code("n/c.cpp", "é", str(tmp_path)) and json.loads(S.read_code("n/c.cpp", str(tmp_path)))["content"] == "é"
    r = spark.createDataFrame([("s/a.cpp", "old", " ")], "path string, text string, new_text string")
    assert S.outputs(r).first()[:] == ("s/a_modernized.cpp", "old")
    assert "digraph" in S.token_graph(CODE) and '"ns::Foo"' in S.token_graph(CODE)
    monkeypatch.setenv("MAX_ATTEMPTS", "99")
    monkeypatch.setenv("X", "yes")
    assert Settings.from_env().max_attempts == 10 and read_bool("X", False) and read_int("NONE", 3, 1, 5) == 3


def test_stream(spark, tmp_path):
    from tessera.streaming.incremental import stream_sources, write_new_functions

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.cpp").write_text("int f() { return 1; }\nint g() { return 1; }\n")
    q = write_new_functions(stream_sources(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.mark.skipif(not native.usable(native.resolve_compiler()), reason="no compiler")
def test_native(spark):
    pairs = spark.createDataFrame([(1, '#include <cstdio>\nint main() { puts("a"); }', '#include <cstdio>\nint main() { puts("b"); }', ["", "x"])], "pair_id long, before string, after string, inputs array<string>")
    d = parity.differential(native.run_pairs(pairs)).first()
    assert not d.parity and d.first_failure == 0
    assert not native.allowed(["rm"]) and not native.allowed([])
    assert not native.verify(spark.createDataFrame([(1, "int main( {")], "file_id long, text string")).first().success


def test_tokens(spark):
    rows = token_table(spark.createDataFrame([(1, "int é;\n/* c */ x += 1;"), (2, None)], "file_id long, text string")).collect()
    assert [(r.text, r.start_byte, r.line) for r in rows] == [("int", 0, 1), ("é", 4, 1), (";", 6, 1), ("x", 16, 2), ("+=", 18, 2), ("1", 21, 2), (";", 22, 2)]


def test_bridge():
    def fails(system, text):
        raise RuntimeError("busy")

    b = Bridge({"modernizer": lambda s, t: t.upper(), "fixer": fails}, wait=0.001, capacity=2)
    assert b("a") == "A" == b("a") and b.stats["hits"] == 1
    assert b.ask("fixer", "", "p = NULL;") == "p = nullptr;" and b.stats["failures"] == 3 and b.ask("planner", "", "x") is None
    for t in "bcd":
        b(t)
    assert len(b.known) == 2 and b.healthy()[0] and not Bridge().healthy()[0]
    with pytest.raises(ValueError):
        Bridge({"cook": fails})


def test_tools(spark, tmp_path, capsys):
    (tmp_path / "a.cpp").write_text("#include <stdio.h>\nint main() { char *p = NULL; return p == NULL; }\n")
    root = str(tmp_path)
    r = json.loads(tools.modernize_file(spark, "a.cpp", root))
    assert r["status"] == "success" and r["output"] == "a_modernized.cpp" and "nullptr" in (tmp_path / "a_modernized.cpp").read_text()
    assert json.loads(tools.modernize_file(spark, "../x.cpp", root))["status"] == "error"
    tools.print_report(json.dumps(r))
    assert "rating" in capsys.readouterr().out
    assert tools.legacy_patterns(spark, str(tmp_path / "a.cpp")).count() == 2 and tools.extract_functions(spark, str(tmp_path / "a.cpp")).first().name == "main"
    assert tools.search(spark, "nullptr", root, "*.cpp").count() == 1
    assert json.loads(tools.run_compiler("rm -rf x", root))["message"] == "only compilers may be run"
    assert json.loads(tools.run_binary("none", root))["status"] == "error"
    # Some boxes have the driver of a compiler without the compiler.
    if native.usable("g++") and json.loads(tools.run_compiler("g++ a.cpp -o a.out", root))["status"] == "success":
        assert json.loads(tools.run_binary("a.out", root))["exit_code"] == 1


def test_no_foreign_imports():
    """The core stands without the training-data subpackage."""
    for top, _, names in os.walk(os.path.join(os.path.dirname(__file__), "..", "tessera")):
        if os.path.basename(top) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"tessera\.llm|corpus_pipeline", open(os.path.join(top, n)).read())


def test_reader_odd_shapes():
    """Operators among members, conditionals that share a brace, attributes, declarators and members' first values."""
    assert list(_one("class A { A& operator=(const A& o) { return *this; } bool operator==(const A& o) const { return true; } int operator()(int x) { return x; } int f() { return 1; } int y = 3; int h() { return 4; } };")) == ["A::operator=", "A::operator==", "A::operator()", "A::f", "A::h"]
    assert list(_one("int a() { return 1; }\n#ifdef X\nint z(int q) {\n#else\nint z(long q) {\n#endif\n return 2; }\nint c() { return 3; }")) == ["a", "z", "c"]
    assert list(_one("#if A\nint a() { return 1; }\n#elif B\nint b() { return 1; }\n#else\nint c() { return 2; }\n#endif\nint d() { return 1;}")) == ["a", "b", "c", "d"]
    assert list(_one("void f() {\n#ifdef A\n#if B\n if (x) {\n#endif\n#else\n if (y) {\n#endif\n g(); }\n}\nint k() { return 1; }")) == ["f", "k"]
    assert list(_one('#ifdef C\nextern "C" {\n#endif\nint k() { return 1; }\n#ifdef C\n}\n#endif\nint m() { return 1; }')) == ["k", "m"]
    assert list(_one("__attribute__((noinline)) int w() { return 1; }\nint (*fp(int a))(int) { return 0; }\n[[nodiscard]] static int q(int x) { return x; }\nalignas(16) struct S { int y() { return 1; } };")) == ["w", "fp", "q", "S::y"]
    assert _one("int (*fp(int a))(int) { return 0; }")["fp"]["parameters"][0]["name"] == "a"
    assert [f["name"] for f in read_text("struct A { A(int a) : x{a}, v{1, 2} { go(); } explicit(true) A(long b) : x(1), v{} {} int g() { return 1; } };")["functions"]] == ["A", "A", "g"]
    assert list(_one("template<> int A<int>::f<long>(int x) { return x; }")) == ["A<int>::f<long>"]


def test_reader_is_linear():
    """Neither nested brackets nor nested scopes nor blank lines take long or fail."""
    import time

    began = time.time()
    assert _one("int f() { return " + "(" * 30000 + "1" + ")" * 30000 + "; }")["f"]
    assert len(read_text("namespace a {" * 3000 + "int f() { return 1; }" + "}" * 3000)["functions"]) == 1
    for text in ("\n" * 60000, "   \n" * 60000, "x;" + "\n" * 60000 + "y;"):
        modernize_text(text)
    assert time.time() - began < 20


@given(st.lists(st.sampled_from(["\n", "\n\n", " ", "\t", "#define A 1", "#define f(x) x", "x();", "x();\n", "x(); y();", "// c", '"s"', "/* a\nb */", "NULL", "\r\n"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_linear_rules_are_the_rules(parts):
    """What is compiled for speed finds what the rule's own regex finds."""
    text = "".join(parts)
    for rule in RULES:
        if rule.linear:
            want = [m.span() for m in re.compile(rule.regex, re.M).finditer(masked(text)) if not rule.same or text[slice(*m.span("a"))] == text[slice(*m.span("b"))]]
            assert [(a, b) for a, b, _ in edits(text, rule)] == want


def test_closure_of_long_chains_and_diamonds(spark):
    chain = [(1, f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    diamonds = [(2, f"{i}", f"{i}{s}") for i in range(12) for s in "ab"] + [(2, f"{i}{s}", f"{i + 1}") for i in range(12) for s in "ab"]
    c = graph.call_closure(spark.createDataFrame(chain + diamonds, "file_id int, src string, dst string"))
    assert c.where("file_id = 1").count() == 820 and c.where("file_id = 2 and src = '0'").count() == 36


def test_lookup_many(spark):
    f = unnest(extract(spark.createDataFrame([(1, "int f(int a) { return 1; }\nint f(char a) { return 2; }\nint g() { return 0; }")], "file_id long, text string")), "functions")
    ids = {r.name: r.unique_fqn for r in f.where("name = 'g'").collect()}
    asked = spark.createDataFrame([(1, "f"), (1, "g"), (1, ids["g"]), (1, "none"), (2, "g")], "file_id long, name string")
    assert {(r.file_id, r.name): (r.n, r.unique_fqn) for r in graph.lookup_functions(f, asked).collect()} == {(1, "f"): (2, None), (1, "g"): (1, ids["g"]), (1, ids["g"]): (1, ids["g"]), (1, "none"): (0, None), (2, "g"): (0, None)}


def test_workflow_routes(spark):
    """What doesn't compile goes to the fixer, whose answer must look like code and compile; a lost function is planned and
    written again; each text is rewritten once a round."""
    code = "int f(int a) { return a; } // padding"
    files = spark.createDataFrame([(1, code), (2, code + " two"), (3, code + " three"), (4, code + " four")], "file_id long, text string")
    calls = spark.sparkContext.accumulator(0)

    def rewriter(t):
        calls.add(1)
        return {" two": t + "\nBROKEN line;", "hree": t + "\nBROKEN HARD;", "four": "int other() { return 1; }"}.get(t[-4:], t)

    def verify(f):
        bad = F.contains("text", F.lit("BROKEN"))
        return f.select("file_id", (~bad).alias("success"), F.when(bad, "a.cpp:2:1: error: BROKEN").otherwise("").alias("error_log"))

    def fixer(text, errors, about):
        assert "error: BROKEN" in errors and "2: BROKEN" in about
        return "short" if "HARD" in text else "```cpp\n" + text.replace("BROKEN line;", "") + "\n```"

    out = {r.file_id: r for r in modernize(files, rewriter, verify, 3, fixer).collect()}
    assert [(out[i].attempts, out[i].success, out[i].semantic_ok) for i in (1, 2, 3, 4)] == [(1, True, True), (2, True, True), (3, False, True), (3, True, False)]
    assert "BROKEN" not in out[2].new_text and out[3].error_log and out[4].issues[0].category == "regression"
    assert calls.value == 4 + 1 + 1  # all files once, and the fourth in two more rounds
    r = json.loads(S.report(modernize(files, lambda t, p: t, planned=True)).first().report)
    assert set(r) == {"file", "metrics", "semantic", "verification"} and r["metrics"]["function_count"] == 1 and r["verification"]["success"]


def test_run_facts(tmp_path):
    """Exit codes, time limits with what was written until then, crashes and findings, of scripts that stand for programs."""
    def script(name, body):
        p = tmp_path / name
        p.write_text("#!/bin/sh\n" + body)
        p.chmod(0o755)
        return str(p)

    assert native.run_program(script("ok", "cat"), "x")["run_success"] and native.run_program(script("three", "exit 3"))["crash_reason"] == "Process exited with non-zero status 3."
    late = native.run_program(script("late", "echo begun; exec sleep 20"), timeout=1)
    assert late["timed_out"] and late["crash_reason"] == "timeout" and late["exit_code"] is None and late["stdout"] in ("begun\n", "")
    r = native.run_program(script("san", "echo '==1==ERROR: AddressSanitizer: leak' >&2; echo '4096 byte(s) allocated' >&2; exit 1"))
    assert r["sanitizer_findings"] == ["==1==ERROR: AddressSanitizer: leak"] and r["peak_memory_kb"]
    assert native.run_program(str(tmp_path / "none"))["crash_reason"] in ("execution_error", "Process exited with non-zero status 127.")
