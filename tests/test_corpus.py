import os

from auditloom.operators import corpus
from auditloom.sources.corpus import binary_files, list_tree, read_contents


def files(spark, rows):
    return spark.createDataFrame([("r", p, c) for p, c in rows], "run_id string, path string, content string")


def paths(df):
    return sorted(r.path for r in df.collect())


def test_pruning_counts_only_below_the_root(spark):
    df = files(spark, [("/build/repo/a.c", ""), ("/build/repo/dist/b.c", ""), ("/build/repo/sub/.git/c", ""), ("/build/repo/building/d.c", "")])
    assert paths(corpus.prune_dirs(df, root="/build/repo")) == ["/build/repo/a.c", "/build/repo/building/d.c"]
    assert paths(corpus.prune_dirs(df, root="/build")) == []
    assert paths(corpus.prune_dirs(df)) == []


def test_extensions(spark):
    df = files(spark, [("a.C", ""), ("a.tar.GZ", ""), (".c", ""), ("d.c/none", ""), ("x.Py", ""), ("a.c.", "")])
    assert paths(corpus.ext_filter(df)) == [".c", "a.C", "x.Py"]


def test_ledger_has_the_first_reason_and_partitions_the_input(spark):
    rows = [
        ("keep.c", "int a;\n"), ("ign.txt", "x"), ("note.txt", "x"), ("big.c", "é" * 30),
        ("bin.c", "a\0b"), ("big.bin", "y" * 99), ("node_modules/x.c", "z"), ("edge.c", "y" * 50),
    ]
    df = files(spark, rows)
    ignored = spark.createDataFrame([("r", "ign.txt"), ("r", "elsewhere")], "run_id string, path string")
    pruned = corpus.prune_dirs(df)
    ledger = {r.path: r.reason for r in corpus.skip_ledger(pruned, ignored, max_bytes=50).collect()}
    assert ledger == {
        "ign.txt": "gitignore", "note.txt": "extension", "big.c": "too large (60 bytes)",
        "bin.c": "binary", "big.bin": "extension",
    }
    kept = corpus.with_skip_reason(pruned, ignored, max_bytes=50).filter("reason is null")
    assert set(paths(kept)) | set(ledger) | {"node_modules/x.c"} == {p for p, _ in rows}
    # non-positive limits mean the default
    assert "big.c" not in paths(corpus.skip_ledger(pruned, None, max_bytes=0))


def test_ignore_list_is_repo_relative(spark):
    df = files(spark, [("/w/a.c", ""), ("/w/sub/b.c", ""), ("/other/a.c", "")])
    ignored = spark.createDataFrame([("r", "a.c")], "run_id string, path string")
    kept, dropped = corpus.ignore_antijoin(df, ignored, repo="/w")
    assert paths(kept) == ["/other/a.c", "/w/sub/b.c"]
    assert paths(dropped) == ["/w/a.c"]
    kept, dropped = corpus.ignore_antijoin(df, None)
    assert kept.count() == 3 and dropped.count() == 0


def test_changed_scope(spark):
    changed = files(spark, [("src/a.c", ""), ("./src/a.c", ""), ("/w/src/x/../b.c", ""), ("", ""), ("srcx/c.c", ""), ("lib", "")])
    roots = spark.createDataFrame([("r", "/w/src/"), ("r", "/w/lib"), ("r", "/w")][:2], "run_id string, root string")
    assert [r.path for r in corpus.changed_scope(changed, roots, "/w").collect()] == ["/w/lib", "/w/src/a.c", "/w/src/b.c"]


def test_snapshot_diff(spark):
    base = files(spark, [("same", "1"), ("mod", "1"), ("gone", "2"), ("moved", "3")])
    head = files(spark, [("same", "1"), ("mod", "2"), ("new", "9"), ("moved2", "3")])
    got = {r.path: r.change for r in corpus.snapshot_diff(head, base).collect()}
    assert got == {"mod": "M", "new": "A"}


def test_one_deletion_explains_one_added_file(spark):
    base = files(spark, [("gone", "3"), ("kept", "5")])
    head = files(spark, [("a", "3"), ("b", "3"), ("kept", "5"), ("c", "5")])
    got = {r.path: r.change for r in corpus.snapshot_diff(head, base).collect()}
    assert got == {"b": "A", "c": "A"}


def test_profile_totals_and_lines(spark):
    df = files(spark, [("b/x.c", "é\n\nlast"), ("b/y.c", "one\r\ntwo\n"), ("b/z.c", "")])
    rows = corpus.source_profile(df, "b").collect()
    assert [(r.display_name, r.lines, r.chars) for r in rows] == [("x.c", 2, 8), ("y.c", 2, 9), ("z.c", 0, 0)]
    runs = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    totals = {r.run_id: (r.files, r.skipped, r.total_lines) for r in corpus.corpus_totals(runs, corpus.with_skip_reason(df, None)).collect()}
    assert totals == {"r": (3, 0, 4), "empty": (0, 0, 0)}
    lines = [(r.path, r.line, r.text) for r in corpus.corpus_lines(df).orderBy("path", "line").collect()]
    assert lines == [("b/x.c", 1, "é"), ("b/x.c", 2, ""), ("b/x.c", 3, "last"), ("b/y.c", 1, "one"), ("b/y.c", 2, "two")]


def test_tree_sources(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"a.c": "x\n", "pkg/__init__.py": "y", ".hidden/h.go": "z", "build/no.c": "n", "pkg/deep/er/e.rs": "e", "bin.c": "a\0"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    os.symlink(root / "a.c", root / "link.c")
    roots = spark.createDataFrame([("r", str(root)), ("r", str(root / "pkg")), ("r", str(root / "a.c"))], "run_id string, root string")
    listed = list_tree(roots)
    names = {r.path[len(str(root)) + 1 :]: r.kind for r in listed.collect()}
    assert names == {"a.c": "file", "pkg/__init__.py": "file", ".hidden/h.go": "file", "pkg/deep/er/e.rs": "file", "bin.c": "file", "link.c": "symlink"}
    ledger = corpus.skip_ledger(read_contents(listed), None).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in ledger) == [("bin.c", "binary"), ("link.c", "symlink")]
    seen = {r.path[len(str(root)) + 1 :] for r in binary_files(spark, "r", [str(root)]).collect()}
    assert {"a.c", "pkg/deep/er/e.rs", "build/no.c"} <= seen
