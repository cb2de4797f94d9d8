"""What the reading makes of macros, old-style parameters and operators, and which files a search passes over."""

import time

from tessera.operators import patterns
from tessera.operators.extract import read_text


def test_macros_and_old_style():
    """Macros that make braces and headers, and parameters declared behind the brackets."""
    read = lambda t: [(f["fqn"], f["start_line"], f["end_line"], [(p["name"], p["type"]) for p in f["parameters"]]) for f in read_text(t)["functions"]]
    assert read("#define BEGIN {\n#define END }\nint f(int a)\nBEGIN\nreturn a;\nEND\nint g() { return 1; }") == [("f", 3, 6, [("a", "int")]), ("g", 7, 7, [])]
    assert read("int add(a, b)\nint a; char *b;\n{\nreturn a;\n}") == [("add", 1, 5, [("a", "int"), ("b", "char")])]
    # Arguments, pasting, strings, variadic ones, continued lines, and one macro within another.
    assert read("#define FN(t, a, ...) t a##_x(__VA_ARGS__)\nFN(int, f, int b, char c) { return 1; }") == [("f_x", 2, 2, [("b", "int"), ("c", "char")])]
    assert read("#define OPEN \\\n  { \\\n  {\nint f() OPEN return 1; } }\nint g() { return 1; }") == [("f", 4, 4, []), ("g", 5, 5, [])]
    assert read('#define S(x) { puts(#x);\nint f() S(a "b" c) }')[0][:3] == ("f", 2, 2)
    # Of branches the first definition counts; what is undefined is a name again.
    assert read("#ifdef A\n#define B {\n#else\n#define B { {\n#endif\nint f() B return 1; }\nint g() { return 1; }") == [("f", 6, 6, []), ("g", 7, 7, [])]
    assert read("#define B {\n#undef B\nint f() B return 1; }\nint g() { return 1; }") == [("g", 4, 4, [])]
    # Not macros that make a value, nor uses within bodies, nor declarations of other kinds.
    assert [c["name"] for f in read_text("#define MAX(a, b) ((a) > (b) ? (a) : (b))\nint f() { return MAX(1, 2); }")["functions"] for c in f["call_details"]] == ["MAX"]
    assert read("int f(T);\nint g(a) const;\nint (*h)(x);\nint i(a) = 0;\nint j(a) int b; {}") == []
    # A macro in itself, without its brackets, never closed, or of the wrong number of arguments.
    assert read("#define A A {\nint f() A return 1; }")[0][0] == "f"
    assert read("#define F(a) { a\nint F; int g() { return 1; }\nF(1") == [("g", 2, 2, [])]
    many = "".join(f"#define A{i} {'A%d ' % (i + 1) * 10}\n" for i in range(9)) + "#define A9 { }\nA0\nint f() { return 1; }"
    assert "expand" in read_text(many)["parse_warning"] and read(many)[0][0] == "f"
    began = time.time()
    for text in ("#define F(a) { a }\n" + "F(" * 20_000, "#define F(a) { a }\n" + "F(" * 20_000 + ")" * 20_000, "".join(f"#define A{i} A{i + 1}\n" for i in range(3000)) + "#define A3000 {\nint f() A0 }", "f(a) int a; " * 20_000, "".join(f"#define A{i} {{\n#undef A{i}\n" for i in range(20_000))):
        read_text(text)
    assert time.time() - began < 20


def test_operator_names():
    names = [f["name"] for f in read_text("struct V { operator bool() const { return 1; } operator const char*() { return 0; } void* operator new[](int n) { return 0; } bool operator==(int x) { return 1; } int operator()(int x) { return x; } };")["functions"]]
    assert names == ["operator bool", "operator const char*", "operator new[]", "operator==", "operator()"]


def test_ignored_folders(spark):
    rows = [("src/layout.h", "int a;"), ("src/combine.cpp", "int a;"), ("lib/object.cpp", "int a;"), ("rebuild/x.c", "int a;"), ("a/.git/x", "int a;"), ("node_modules/x.c", "int a;"), (None, "int a;")]
    got = patterns.search_lines(spark.createDataFrame(rows, "path string, text string"), "int a")
    assert {r.path for r in got.collect()} == {"src/layout.h", "src/combine.cpp", "lib/object.cpp", None}
