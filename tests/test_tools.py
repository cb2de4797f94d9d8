"""Indexed search, running sums, line differences, the typedef rule, and pairs of programs."""

import os
import random
import re
import sys
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import native
from tessera.operators import linediff, patterns
from tessera.operators.parity import differential
from tessera.operators.rules import RULES, modernize_text, typedefs
from tessera.operators.running import running_sum
from tessera.operators.search_index import ALWAYS, Needs, SearchIndex, required
from tessera.sources.scratch import Scratch

EXPRESSIONS = [
    "malloc", "std::", "mal+oc", "(foo|bar)baz", "(?i)hello", "[abc]def", "a.c", "x{3,5}yz", "colou?r", r"^#include <[a-z]+\.h>$", r"\bNULL\b", "é+x", "(abc)*def", r"\Qa.b\E", "[a&&b]cde", r"\d{3}-\d{4} tel", "foo(?=bar)", "(?<!x)abcd", "(a|b|)cde", "[^a]bcd", "(?i:AB)cd", "a{9}b", "zzz|", "nothing at all",
]


def test_indexed_search(spark, tmp_path):
    """The rows of a full scan, from the files alone that can have some."""
    r = random.Random(4)
    pieces = ["malloc", "std::", "foobaz", "barbaz", "Hello", "HELLO", "adef", "xxxyz", "xxxxxxyz", "color", "colour", "#include <a.h>", "NULL", "NULLS", "ééx", "abcabcdef", "a.b", "acde", "123-4567 tel", "foobar", "xabcd", "abcd", "cde", "bbcd", "aBcd", "a" * 9 + "b", "é", "\r", "\t", " ", ""]
    rows = [(i, f"d{i % 5}/f{i}", "\n".join("".join(r.choices(pieces, k=3)) + f" own{i}" for _ in range(4))) for i in range(60)]
    rows += [(60, "build/x", "malloc"), (61, "empty", ""), (62, "null", None), (63, "two", "ab")]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    index = SearchIndex(spark, str(tmp_path / "index")).build(files, 8)
    told = lambda df: sorted((x.path, x.line, x.text) for x in df.collect())
    fewer = 0
    for e in EXPRESSIONS:
        got, want = told(index.search(e)), told(patterns.search_lines(files, e))
        assert got == want, e
        fewer += index.files(e).count() < len(rows) / 2
    assert fewer >= 10
    assert [x.file_id for x in index.files("own17").collect()] == [17] and index.candidates("own1[0-9]").count() == 10
    assert index.files("nothing at all").count() == 0 and index.candidates(r"\d+") is None
    assert SearchIndex(spark, str(tmp_path / "none")).build(files.where("false")).search("malloc").count() == 0


def _holds(needs, text: bytes) -> bool:
    parts = (_holds(x, text) if isinstance(x, Needs) else x in text for x in needs.parts)
    return all(parts) if needs.how == "all" else any(parts)


_PART = st.recursive(
    st.sampled_from(["a", "b", "cd", "é", ".", "[ab]", "[^a]", r"\w", "abc", r"\.", "^", "$", r"\b"]),
    lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda p: f"(?:{p[0]}|{p[1]})"), st.tuples(x, st.sampled_from(["*", "+", "?", "{2}", "{1,3}", "+?", "{0}"])).map(lambda p: f"(?:{p[0]}){p[1]}"), x.map(lambda p: f"(?i:{p})")),
    max_leaves=8,
)


@settings(max_examples=1500, deadline=None)
@given(_PART, st.lists(st.sampled_from(["a", "b", "A", "cd", "abc", "é", "É", ".", "x"]), max_size=10).map("".join))
def test_required_is_sound(regex, line):
    """What an expression finds holds what it is told to require."""
    if re.search(regex, line):
        assert _holds(required(regex), line.encode())


def test_required():
    assert required("malloc") == Needs("all", (b"mal", b"all", b"llo", b"loc"))
    assert required("ab") == required(".*") == required("(?x) a b c d") == required("(") == required("[[a]b]cde") == required(r"a\Rbcde") == ALWAYS
    assert required("abc|x") == ALWAYS and required("(abc|def)g?") == Needs("any", (Needs("all", (b"abc",)), Needs("all", (b"def",)))) or required("(abc|def)g?").how == "any" or required("(abc|def)g?").parts


def test_running_sum(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(9)) for i in range(500)] + [(1000, None)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(3)
    got = {x.k: x.before for x in running_sum(df, "n", [F.col("k")], Scratch(spark, "test")).collect()}
    total = 0
    for k, n in rows:
        assert got[k] == total
        total += n or 0
    assert running_sum(df.where("false"), "n", [F.col("k")], Scratch(spark, "test")).count() == 0


def test_search_code_plan(spark):
    files = spark.createDataFrame([(f"f{i}", "x\n" * i) for i in range(40)], "path string, text string")
    found = patterns.search_code(files, "x", 100)
    # By path: f0, f1, f10, f11 .. f19, f2, f20 ..: the file that brings the matches over the limit is the last.
    n, want = 0, set()
    for p, k in sorted((f"f{i}", i) for i in range(1, 40)):
        if n <= 100:
            want.add(p)
        n += k
    assert {r.path for r in found.collect()} == want
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=800, deadline=None)
@given(*[st.lists(st.sampled_from("aabbc de"), max_size=14)] * 2)
def test_shortest_script(a, b):
    found = linediff.matches(a, b)
    assert len(found) == _longest(a, b) and all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


@settings(max_examples=400, deadline=None)
@given(*[st.one_of(st.none(), st.lists(st.sampled_from("aabbcde"), max_size=30).map("\n".join))] * 2, st.integers(0, 4))
def test_unified(a, b, context):
    """A diff makes one text of the other, and its hunks are those of the rows."""
    old, new, told = a.split("\n") if a is not None else [], b.split("\n") if b is not None else [], linediff.unified(a, b, context).split("\n")[2:]
    out, at, hunks = [], 0, 0
    for line in told:
        if m := re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            begin = int(m[1]) - (m[2] != "0")
            out += old[at:begin]
            at, hunks = begin, hunks + 1
            assert len(out) == int(m[3]) - (m[4] != "0")
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert old[at] == line[1:]
            at += 1
            out += [line[1:]] if line[0] == " " else []
    assert out + old[at:] == new
    rows = linediff.changes(a, b, context)
    assert max((h for h, *_ in rows), default=0) == hunks and [x[1] + x[4] for x in rows] == [x for x in told if x[0] in "+-"]
    assert all((old[i - 1] if op == "-" else new[j - 1]) == x and (i is None) == (op == "+") for _, op, i, j, x in rows)


def test_long_diff():
    r = random.Random(5)
    a = [str(r.randrange(2000)) for _ in range(30_000)]
    b = list(a)
    for _ in range(900):
        b[r.randrange(len(b))] = str(r.randrange(2000))
    began = time.time()
    assert 900 < len(linediff.changes("\n".join(a), "\n".join(b))) <= 1800
    assert linediff.changes("\n".join(a), "\n".join(str(r.randrange(2000)) for _ in range(30_000)))
    assert time.time() - began < 30


def test_line_changes(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nB\nc\nd"), (2, "x", "x"), (3, None, "n"), (4, None, None), (1, "", None)], "id long, before string, after string")
    got = sorted(tuple(r) for r in linediff.line_changes(df).select("id", "hunk", "op", "text").collect())
    assert got == [(1, 1, "+", "B"), (1, 1, "+", "d"), (1, 1, "-", ""), (1, 1, "-", "b"), (3, 1, "+", "n")]


_TYPEDEF = next(r for r in RULES if r.finder)


@settings(max_examples=4000, deadline=None)
@given(st.lists(st.sampled_from(["typedef", "typedef ", " ", "  ", "\n", "a", "B1", "1x", "*", ";", "{", "}", "_", "int ", "é", "::", "x;"]), max_size=16).map("".join))
def test_typedefs(text):
    """The one pass finds what the rule's expression does."""
    assert list(typedefs(text)) == [(m.span(), m.span(1), m.span(2)) for m in re.finditer(_TYPEDEF.regex, text, re.M)]


def test_typedefs_are_linear():
    began = time.time()
    for text in ("typedef a " * 60_000, "typedef " + " " * 60_000 + "b", "typedef a" + " " * 60_000 + "b c;", ("typedef a" + " " * 300) * 300 + "{", "typedef " + "a" * 60_000 + ";"):
        modernize_text(text)
    assert time.time() - began < 5


def _scripts():
    """A builder of programs of shell scripts, where no compiler is at hand; one with "error" in it doesn't build."""

    def build(code: str, out: str) -> dict:
        ok = "error" not in code
        with open(out, "w") as f:
            f.write("#!/bin/sh\n" + code + "\n")
        os.chmod(out, 0o755)
        return {"success": ok, "errors": [] if ok else ["error: x"], "raw_stderr": "" if ok else "error: x", "sanitized": False}

    return build


def test_paired_runs(spark):
    """Both programs run a case in turn, up to the first in which they differ."""
    echo = "read x; echo $x"
    rows = [(1, echo, echo + "; echo more", ["a\n", "b\n", "c\n"]), (2, echo, echo + '; test $x != b || echo more', ["a\n", "b\n", "c\n"]), (3, echo, echo + "; printf '  \\r\\n\\n'", ["a\n", "b\n", "c\n"]), (4, echo, "error", ["a", "b"]), (5, echo, echo + "; exit 3", None), (6, echo, echo + "; echo warned >&2", ["a\n", "b\n"])]
    pairs = spark.createDataFrame(rows, "pair_id long, before string, after string, inputs array<string>")
    runs = native.run_pairs(pairs, build=_scripts()).cache()
    assert {r.pair_id: r["count"] for r in runs.groupBy("pair_id").count().collect()} == {1: 2, 2: 4, 3: 6, 4: 2, 5: 2, 6: 2}
    told = {r.pair_id: (r.parity, r.first_failure, r.cases_run) for r in differential(runs).collect()}
    assert told == {1: (False, 0, 1), 2: (False, 1, 2), 3: (True, None, 3), 4: (False, 0, 1), 5: (False, 0, 1), 6: (False, 0, 1)}
    every = native.run_pairs(pairs.where("pair_id < 3"), whole=True, build=_scripts())
    assert every.count() == 12 and {r.pair_id: r.first_failure for r in differential(every).collect()} == {1: 0, 2: 1}


def test_limits(tmp_path):
    """A late program goes with what it started; one that wants too much memory or writes without end is stopped."""

    def run(code, **more):
        _scripts()(code, str(tmp_path / "p"))
        return native.run_program(str(tmp_path / "p"), **more)

    began = time.time()
    r = run("echo begun; sleep 97531 & wait", timeout=2)
    assert r["timed_out"] and not r["run_success"] and r["stdout"] == "begun\n" and time.time() - began < 30
    assert run("sleep 97532 & exit 0")["run_success"]
    time.sleep(0.2)
    assert not _running("97531") and not _running("97532")
    big = f"exec {sys.executable} -S -c 'x = bytearray({{}} << 20); print(len(x))'"
    assert not run(big.format(900), memory_mb=400)["run_success"]
    assert run(big.format(10), memory_mb=400)["stdout"] == f"{10 << 20}\n"
    r = run("while true; do echo again; done", output_mb=1)
    assert not r["run_success"] and len(r["stdout"]) <= 1 << 20
    assert run("read x; echo $x", stdin="é\n")["stdout"] == "é\n" and native.run_program("/no/such")["crash_reason"]


def _running(word: str) -> bool:
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{pid}/cmdline", "rb") as f:
                if f.read().split(b"\0")[:2] == [b"sleep", word.encode()]:
                    return True
        except OSError:
            continue
    return False
