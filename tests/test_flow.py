"""Versions in a stream, kept answers, and runs that another session goes on with."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.rules import modernize_text
from tessera.plans.answers import Answers, prompt_key
from tessera.plans.workflow import ask, modernize
from tessera.sources.scratch import Run
from tessera.streaming.changes import stream_snapshots, write_changes
from tessera.streaming.incremental import stream_sources, write_new_functions


def test_versions(spark, tmp_path):
    """Three versions of a file, the stream restarted between them; a late one, one without text, and two at once."""

    def put(version, path, text):
        at = tmp_path / "in" / str(version) / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)

    def told():
        write_changes(stream_snapshots(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return {(r.path, r.version, r.unique_fqn.split("#")[0], r.change, r.start_line) for r in rows}

    put(1, "a/x y+1.cpp", "int f() { return 1; }\nint g() { return 1; }\n")
    put(1, "b.cpp", "int h() { return 1; }")
    first = {("a/x y+1.cpp", 1, "f", "added", 1), ("a/x y+1.cpp", 1, "g", "added", 2), ("b.cpp", 1, "h", "added", 1)}
    assert told() == first
    put(2, "a/x y+1.cpp", "\nint f() { return 2; }\nint k() { return 1; }\n")
    second = first | {("a/x y+1.cpp", 2, "f", "changed", 2), ("a/x y+1.cpp", 2, "k", "added", 3), ("a/x y+1.cpp", 2, "g", "removed", 2)}
    assert told() == second
    put(0, "b.cpp", "int late() { return 1; }")
    put(3, "a/x y+1.cpp", "int f() { return 1; }\n")
    put(4, "a/x y+1.cpp", "\n\nint f() { return 1; }\n")  # moved, not changed
    put(5, "a/x y+1.cpp", "\n")
    put(6, "a/x y+1.cpp", "int g() { return 1; }")
    third = second | {("a/x y+1.cpp", 3, "f", "changed", 1), ("a/x y+1.cpp", 3, "k", "removed", 3), ("a/x y+1.cpp", 5, "f", "removed", 3), ("a/x y+1.cpp", 6, "g", "added", 1)}
    assert told() == third == told()


def test_new_functions(spark, tmp_path):
    """Whole files are read, and a body that comes back after a restart isn't told again."""
    (tmp_path / "in").mkdir()

    def told():
        write_new_functions(stream_sources(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        return sorted(r.fqn for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.cpp").write_text("int f()\n{\n return 1;\n}\nint g()\n{\n return 2;\n}\n")
    assert told() == ["f", "g"]
    (tmp_path / "in" / "b.cpp").write_text("int h()\n{\n return 1;\n}\nint k()\n{\n return 3;\n}\n")
    assert told() == ["f", "g", "k"]


@pytest.fixture
def calls(tmp_path):
    """A folder in which a function that Spark's workers call leaves a line for each call."""
    at = tmp_path / "calls"
    at.mkdir()

    def count():
        return sorted(x for f in at.iterdir() for x in f.read_text().splitlines())

    return str(at), count


def _noted(folder):
    def call(text, *more):
        with open(os.path.join(folder, str(os.getpid())), "a") as f:
            f.write(text.split("\n")[0] + "\n")
        return None if text.startswith("none") else text.upper()

    return call


def test_answers(spark, tmp_path, calls):
    folder, count = calls
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)] + [(20, "none"), (21, None)], "id int, text string")
    kept = Answers(spark, str(tmp_path / "kept"), wave=3, batch=2)
    assert kept.table().count() == 0
    got = {r.id: r.answer for r in ask(rows, _noted(folder), "text", role="x", answers=kept).collect()}
    assert got == {i: f"TEXT {i % 7}" for i in range(20)} | {20: None, 21: ""}
    # What fails is tried thrice here, but null isn't a failure: each prompt was asked about once.
    assert count() == sorted({f"text {i}" for i in range(7)} | {"none", ""})
    again = {r.id: r.answer for r in ask(rows, _noted(folder), "text", role="x", answers=Answers(spark, str(tmp_path / "kept"))).collect()}
    assert again == got and count() == sorted([*{f"text {i}" for i in range(7)}, "none", "none", ""])
    # Another role is asked for itself; an answer that is there twice counts once, the earlier one.
    assert ask(rows.where("id = 0"), _noted(folder), "text", role="y", answers=kept).first().answer == "TEXT 0" and count().count("text 0") == 2
    key = rows.where("id = 0").select(prompt_key("x", "text")).first()[0]
    spark.createDataFrame([(key, "LATER", "")], "key string, answer string, run string").withColumn("asked_at", F.current_timestamp()).write.mode("append").parquet(kept.path)
    assert kept.table().where(F.col("key") == key).collect()[0].answer == "TEXT 0" and ask(rows.where("id = 0"), _noted(folder), "text", role="x", answers=kept).count() == 1


def test_answers_survive_a_failure(spark, tmp_path, calls):
    """A wave that fails costs no answer of the waves before it."""
    folder, count = calls
    noted = _noted(folder)

    def breaks(text):
        if not os.path.exists(f"{folder}.mended") and text == "text 5":
            raise ValueError("down")
        return noted(text)

    prompts = spark.createDataFrame([(f"text {i}",) for i in range(12)], "text string").withColumn("key", prompt_key("", "text")).select("key", "text")
    kept = Answers(spark, str(tmp_path / "kept"), wave=2, batch=1)
    with pytest.raises(Exception, match="down"):
        kept.ask(prompts, breaks)
    known = {r.answer for r in kept.table().collect()}
    before = count()
    open(f"{folder}.mended", "w").close()
    assert kept.ask(prompts, breaks).where("answer is null").count() == 0
    asked = list(count())
    for x in before:
        asked.remove(x)
    assert not {x.upper() for x in asked} & known and len(set(asked)) == 12 - len(known)


FILES = [(1, "int f() { return NULL; }\n"), (2, "int g() { return 1; }\n"), (3, "int h() { return 2; }\n")]


def _rewrites(folder):
    noted = _noted(folder)

    def call(text):
        noted(text)
        return text + "int BROKEN;\n" if "h()" in text else text

    return call


def _verify(files):
    bad = F.contains("text", F.lit("BROKEN"))
    return files.select("file_id", (~bad).alias("success"), F.when(bad, "a.cpp:1:1: error: x").otherwise("").alias("error_log"))


def test_resume(spark, tmp_path, calls):
    """A run that stops after a round goes on, in a session of its own, without a call for files that are done."""
    folder, count = calls
    files = spark.createDataFrame(FILES, "file_id long, text string")
    whole = {r.file_id: (r.attempts, r.success, r.new_text) for r in modernize(files, _rewrites(folder), _verify, 2).collect()}
    assert whole[1] == (1, True, modernize_text(FILES[0][1])[0].strip()) and whole[3][:2] == (2, False)
    begun = count()
    assert begun == sorted([modernize_text(t)[0].split("\n")[0] for _, t in FILES] + ["int h() { return 2; }"])
    run = str(tmp_path / "run")
    first = modernize(files, _rewrites(folder), _verify, 2, run=run, rounds=1)
    assert {r.file_id for r in first.collect()} == {1, 2} and len(count()) == len(begun) + 3
    other = spark.newSession().createDataFrame(FILES, "file_id long, text string")
    done = {r.file_id: (r.attempts, r.success, r.new_text) for r in modernize(other, _rewrites(folder), _verify, 2, run=run).collect()}
    assert done == whole and len(count()) == len(begun) + 4 and count().count("int g() { return 1; }") == 2
    # Once more, it is all there.
    assert {r.file_id for r in modernize(files, _rewrites(folder), _verify, 2, run=run).collect()} == {1, 2, 3} and len(count()) == len(begun) + 4
    told = json.loads((tmp_path / "run" / "manifest.json").read_text())
    assert {"parsed", "plans", "round1", "round2"} <= set(told["tables"]) and told["about"]["files"] == 3
    with pytest.raises(ValueError, match="other data"):
        modernize(files.where("file_id < 3"), _rewrites(folder), _verify, 2, run=run)
    with pytest.raises(ValueError):
        modernize(files, _rewrites(folder), _verify, 2, rounds=1)


def test_resume_within_a_round(spark, tmp_path, calls):
    """A round that breaks off when it is compiled doesn't ask the rewriter again; nor with answers one that breaks off within."""
    folder, count = calls
    files = spark.createDataFrame(FILES, "file_id long, text string")

    def down(files):
        raise OSError("no compiler")

    run, answers = str(tmp_path / "run"), Answers(spark, str(tmp_path / "answers"))
    with pytest.raises(OSError):
        modernize(files, _rewrites(folder), down, 1, run=run, answers=answers)
    assert len(count()) == 3
    assert modernize(files, _rewrites(folder), _verify, 1, run=run, answers=answers).count() == 3 and len(count()) == 3
    # Another run over the same texts has the answers, too.
    assert modernize(files, _rewrites(folder), _verify, 1, run=str(tmp_path / "more"), answers=answers).count() == 3 and len(count()) == 3


def test_manifest(spark, tmp_path):
    """A table that was written without being committed is written again; a manifest lost in a rename is found."""
    at = str(tmp_path / "run")
    one = Run(spark, at, {"a": 1})
    df = spark.range(3)
    df.write.parquet(f"{at}/t")
    assert not one.has("t") and one.write(spark.range(5), "t").count() == 5 and one.write(spark.range(9), "t").count() == 5
    os.rename(f"{at}/manifest.json", f"{at}/manifest.json.new")
    for name in os.listdir(at):
        if name.startswith(".manifest"):
            os.remove(f"{at}/{name}")
    assert Run(spark, at, {"a": 1}).has("t")
    with pytest.raises(ValueError):
        Run(spark, at, {"a": 2})
