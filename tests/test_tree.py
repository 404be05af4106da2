"""The tree source, its stream, and files with names."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from auditloom.sources import files, named, tree
from auditloom.streaming import live


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "repo"
    for name, data in {
        "a.c": b"int a;\n", "_x.c": b"x", ".github/_w.YML": b"on: push", "src/b.GO": b"package b\n\x00", "src/deep/big.c": b"y" * 900,
        "node_modules/n.js": b"no", "src/build/o.c": b"no", "empty.c": b"", "noext": b"z",
    }.items():
        put(top / name, data)
    os.symlink(top / "a.c", top / "link.c")
    os.symlink(top / "src", top / "linked")
    put(tmp_path / "apart" / "single.c", b"single")
    return top


def test_tree_keeps_every_name(spark, root, tmp_path):
    single = str(tmp_path / "apart" / "single.c")
    roots = {"r": [str(root), str(root / "src"), single], "other": [single], "pruned": [str(root / "node_modules")]}
    for size in (1, 1 << 20):  # one file a partition, or all in one
        df = tree.read_tree(spark, roots, partition_bytes=size)
        rows = {(r.run_id, os.path.relpath(r.path, tmp_path)): r for r in df.collect()}
        assert df.count() == len(rows)
        assert {p for run, p in rows if run == "r"} == {
            "repo/a.c", "repo/_x.c", "repo/.github/_w.YML", "repo/src/b.GO", "repo/src/deep/big.c", "repo/empty.c", "repo/noext",
            "repo/link.c", "repo/linked", "apart/single.c",
        }
        assert [p for run, p in rows if run != "r"] == ["apart/single.c"]
        assert rows["r", "repo/link.c"].kind == rows["r", "repo/linked"].kind == "symlink"
        assert rows["r", "repo/link.c"].content is None and rows["r", "repo/empty.c"].content == b""
        assert rows["r", "repo/.github/_w.YML"].ext == ".yml" and rows["r", "repo/noext"].ext == ""
        assert rows["r", "repo/src/b.GO"].content == b"package b\n\x00"


def test_partitions_are_bounded(spark, tmp_path):
    for k in range(40):
        put(tmp_path / "t" / f"f{k:02}.c", b"x" * 1000)
    df = tree.read_tree(spark, {"r": [str(tmp_path / "t")]}, partition_bytes=8 * (1000 + tree.OPEN_BYTES))
    assert df.rdd.getNumPartitions() == 5 and df.count() == 40


def test_a_range_looks_at_its_own_names_only(tmp_path, monkeypatch):
    """A directory of many partitions costs each of them its own files, not all."""
    for k in range(40):
        put(tmp_path / "t" / f"f{k:02}.c", b"x")
    seen = []
    look = files._local
    monkeypatch.setattr(files, "_local", lambda path, name: seen.append(name) or look(path, name))
    walk = tree._Walk({"roots": json.dumps({"r": [str(tmp_path / "t")]}), "partitionBytes": str(8 * (1 + tree.OPEN_BYTES))})
    parts = walk.slices()
    seen.clear()
    rows = [row for part in parts for row in walk.rows(part)]
    assert len(parts) == 5 and len(rows) == 40 and len([n for n in seen if n != "t"]) == 40


def test_filters_are_pushed_and_exact(spark, root, tmp_path):
    plain = tree.read_tree(spark, {"r": [str(root)]})
    kept = plain.filter(F.col("ext").isin(".c", ".go") & (F.col("length") <= 100) & (F.col("kind") == "file"))
    plan = kept._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "ext IN" in plan or "In(ext" in plan, plan
    assert sorted(r.path.rsplit("/", 1)[1] for r in kept.collect()) == ["_x.c", "a.c", "b.GO", "empty.c"]
    assert plain.filter("length < 1").count() == 1
    assert plain.filter("ext = '.c' AND ext = '.go'").count() == 0
    # a file that no filter lets through is not opened
    os.chmod(root / "src" / "deep" / "big.c", 0)
    assert plain.filter("length <= 100 AND kind = 'unreadable'").count() == 0


def test_no_such_root(spark, tmp_path):
    assert [r.kind for r in tree.read_tree(spark, {"r": [str(tmp_path / "none")]}).collect()] == ["unreadable"]
    assert tree.read_tree(spark, {}).collect() == []


def test_three_drains(spark, root, tmp_path):
    folder = str(tmp_path / "live")

    def drain():
        stream = live.changed_files(tree.stream_tree(spark, {"r": [str(root)]}))
        rows = live.drain_append(live.arriving_files(stream, base=str(root)), folder)
        return sorted((r.display_name, r.lines, r.chars, r.reason) for r in rows.collect())

    first = drain()
    assert (".github/_w.YML", 0, 8, "extension") in first and ("a.c", 1, 7, None) in first and ("_x.c", 0, 1, None) in first
    assert ("link.c", None, None, "symlink") in first
    put(root / "a.c", b"int a;\nint b;\n")
    put(root / ".new.c", b"new\n")
    os.utime(root / "empty.c")  # touched, not changed
    second = drain()
    assert sorted(set(second) - set(first)) == [(".new.c", 1, 4, None), ("a.c", 2, 14, None)]
    assert len(second) == len(first) + 2
    time.sleep(0.01)
    put(root / "a.c", b"int a;\n")  # changed back
    third = drain()
    assert len(third) == len(second) + 1 and third.count(("a.c", 1, 7, None)) == 2
    assert drain() == third


@pytest.mark.parametrize("groups", [None, 1])
def test_paths_share_a_state(spark, tmp_path, monkeypatch, groups):
    """Many more paths than steps of Python; paths of one state change apart from each other."""
    assert live.STATE_GROUPS <= 1 << 16  # steps do not grow with the files
    monkeypatch.setattr(live, "STATE_GROUPS", groups or live.STATE_GROUPS)
    top = tmp_path / "many"
    for k in range(30):
        put(top / f"f{k}.c", b"1")

    def drain():
        stream = live.changed_files(tree.stream_tree(spark, {"r": [str(top)], "q": [str(top)]}))
        rows = live.drain_append(stream.select("run_id", "path", "content"), str(tmp_path / "live"))
        return sorted((r.run_id, r.path.rsplit("/", 1)[1], bytes(r.content)) for r in rows.collect())

    first = drain()
    assert first == sorted((run, f"f{k}.c", b"1") for run in "rq" for k in range(30))
    put(top / "f3.c", b"2")
    put(top / "f30.c", b"1")
    second = drain()
    assert second == sorted(first + [(run, *new) for run in "rq" for new in (("f3.c", b"2"), ("f30.c", b"1"))])
    assert drain() == second


def test_named_files(spark, tmp_path):
    out = tmp_path / "out"
    rows = [(f"run=a b/d{k % 3}/f{k}~2.md", f"text {k}") for k in range(30)] + [("top.json", "{}"), ("empty", None)]
    named.write_files(spark.createDataFrame(rows, "path string, content string").repartition(4), str(out))
    found = {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()}
    assert found == {p: c or "" for p, c in rows}
    named.write_files(spark.createDataFrame([("top.json", "[]")], "path string, content string"), str(out))
    assert (out / "top.json").read_text() == "[]" and (out / "empty").exists()
    with pytest.raises(Exception, match="not a name inside"):
        named.write_files(spark.createDataFrame([("ok", "x"), ("../out", "x")], "path string, content string"), str(out))
    assert not [p for p in out.iterdir() if p.name.startswith(".staging")] and not (out / "ok").exists()


def test_failed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    bad = spark.range(20).selectExpr(
        "concat('f', id) as path", "if(id = 17, raise_error('lost'), 'x') as content"
    ).repartition(4)
    with pytest.raises(Exception, match="lost"):
        named.write_files(bad, str(out))
    assert not out.exists() or list(out.iterdir()) == []


def test_file_systems():
    system, path = files.opened("file:///tmp/x")
    assert path == "/tmp/x" and files.look(system, "/no/such/file").kind == "unreadable"
    assert files.opened("/tmp/x")[1] == "/tmp/x" and files.listed(system, "/no/such/folder") == []
