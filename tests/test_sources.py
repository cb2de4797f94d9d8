"""The data source of source files: listing, reading and writing below a root."""

import os

import pytest

from tessera.sources import files as S
from tessera.sources.datasource import SourceFiles


@pytest.fixture
def at(spark, tmp_path):
    spark.dataSource.register(SourceFiles)
    read = lambda path="", **more: spark.read.format("source_files").options(root=str(tmp_path), path=path, **more).load()
    write = lambda rows, path, mode: spark.createDataFrame(rows, "path string, text string").repartition(3).write.format("source_files").options(root=str(tmp_path), path=path).mode(mode).save()
    return tmp_path, read, write


def rows(df):
    return {r.path: (r.name, r.type, r.size, r.text) for r in df.collect()}


def test_list_and_read(at):
    root, read, _ = at
    (root / "src" / "deep" / "more").mkdir(parents=True)
    (root / "src" / "none").mkdir()
    (root / "src" / "a b+é.cpp").write_text("int f() { return 1; }")
    (root / "src" / "deep" / "x.h").write_text("é")
    (root / "src" / "deep" / "more" / "bad").write_bytes(b"\xff\xfe")
    (root / "out.txt").write_text("not below")
    assert rows(read("src")) == {"a b+é.cpp": ("a b+é.cpp", "file", 21, None), "deep": ("deep", "directory", None, None), "deep/x.h": ("x.h", "file", 2, None), "deep/more": ("more", "directory", None, None), "deep/more/bad": ("bad", "file", 2, None), "none": ("none", "directory", None, None)}
    assert {k: v[3] for k, v in rows(read("src", texts="true")).items() if v[1] == "file"} == {"a b+é.cpp": "int f() { return 1; }", "deep/x.h": "é", "deep/more/bad": None}
    assert set(rows(read("src", recursive="false"))) == {"a b+é.cpp", "deep", "none"}
    assert read("src", parts="2").rdd.getNumPartitions() == 2 and rows(read("src", parts="2")) == rows(read("src"))
    assert rows(read("src/none")) == {}
    os.symlink("/etc", root / "src" / "none" / "link")
    for path in ("../", "/etc", "src/../../x", "src/none/link"):
        with pytest.raises(Exception, match="outside"):
            read(path).collect()


def test_write(at):
    root, read, write = at
    first = [(f"d{i % 3}/f{i}.c", f"text {i}") for i in range(20)] + [("blank.c", None)]
    write(first, "out", "overwrite")
    assert {k: v[3] for k, v in rows(read("out", texts="true")).items() if v[1] == "file"} == {p: t or "" for p, t in first}
    write([("d0/f0.c", "new"), ("d9/z.c", "z")], "out", "append")
    told = {k: v[3] for k, v in rows(read("out", texts="true")).items() if v[1] == "file"}
    assert len(told) == 22 and told["d0/f0.c"] == "new" and told["d9/z.c"] == "z"
    write([("only.c", "x")], "out", "overwrite")
    assert set(rows(read("out"))) == {"only.c"}
    write([], "deep/new", "overwrite")
    assert (root / "deep" / "new").is_dir()
    # A row that leaves the folder fails the job, which leaves all as it was.
    for path in ("../x.c", "/etc/x.c", "", None):
        with pytest.raises(Exception):
            write([("fine.c", "x"), (path, "x")], "out", "overwrite")
    assert set(rows(read("out"))) == {"only.c"} and sorted(os.listdir(root)) == ["deep", "out"]


def test_list_directory(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.c").write_text("x")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert [tuple(r) for r in S.list_directory(spark, ".", root).collect()] == [("a.c", "file"), ("b", "directory")]
        assert S.list_directory(spark, "b", root).count() == 0
        for path in ("..", "/etc", "b/../.."):
            with pytest.raises(PermissionError):
                S.list_directory(spark, path, root)


def test_a_folder_is_read_in_parts(tmp_path):
    from tessera.sources import datasource as D

    (tmp_path / "src" / "one" / "deep").mkdir(parents=True)
    for i in range(2 * D.ENTRIES + 3):
        (tmp_path / "src" / "one" / f"f{i}.c").write_text("x" * (i % 7))
    for i in range(3):
        (tmp_path / "src" / "one" / "deep" / f"large{i}.c").write_text("x" * D.TEXT_BYTES)
    r = D._Reader({"root": str(tmp_path), "path": "src", "texts": "true"})
    got = [b for p in r.partitions() for b in r.read(p)]
    assert max(b.num_rows for b in got) <= D.ENTRIES and max(sum(map(len, filter(None, b.column("text").to_pylist()))) for b in got) < 2 * D.TEXT_BYTES
    told = {x["path"]: x["size"] for b in got for x in b.to_pylist()}
    assert len(told) == sum(b.num_rows for b in got) == 2 * D.ENTRIES + 3 + 5
    assert told["one/f6.c"] == 6 and told["one/deep/large2.c"] == D.TEXT_BYTES and told["one"] is None and told["one/deep"] is None
