"""Ignore rules on literal cases."""

import pytest

from auditloom.operators.ignore_rules import ignored_by_rules

PATHS = [
    "tracked.go", "ignored.go", "ignored-dir/inside.go", "ignored-dir/deep/x.go", "src/a.c", "src/b.c", "src/deep/a.c", "src/deep/k.o",
    "lib/a.c", "lib/keep.o", "lib/x y.o", "docs/a/b/c.md", "docs/z.md", "build", "a+b.c", "q*.c", "qz.c", "#n", "!n", "é/ü.c",
]


@pytest.mark.parametrize(
    ("rules", "want"),
    [
        ([("", "ignored.go"), ("", "ignored-dir/")], {"ignored.go", "ignored-dir/inside.go", "ignored-dir/deep/x.go"}),
        ([("", "*.o"), ("", "!keep.o")], {"src/deep/k.o", "lib/x y.o"}),
        ([("", "/src/*.c")], {"src/a.c", "src/b.c"}),
        ([("", "src/**/a.c")], {"src/a.c", "src/deep/a.c"}),
        ([("", "**/a.c"), ("lib", "!a.c")], {"src/a.c", "src/deep/a.c"}),
        ([("", "lib"), ("lib", "!keep.o")], {"lib/a.c", "lib/keep.o", "lib/x y.o"}),  # closed below
        ([("", "docs/**")], {"docs/a/b/c.md", "docs/z.md"}),
        ([("docs", "a/*/c.md"), ("docs", "/z.md")], {"docs/a/b/c.md", "docs/z.md"}),
        ([("", "build/")], set()),  # a file, not a directory
        ([("", "a+b.c"), ("", r"q\*.c")], {"a+b.c", "q*.c"}),
        ([("", "q?.c")], {"q*.c", "qz.c"}),
        ([("", "[!a]*.go")], {"tracked.go", "ignored.go", "ignored-dir/inside.go", "ignored-dir/deep/x.go"}),
        ([("", "# comment"), ("", ""), ("", "   "), ("", r"\#n"), ("", r"\!n")], {"#n", "!n"}),
        ([("", "x\\ y.o  ")], {"lib/x y.o"}),
        ([("", "ü.*")], {"é/ü.c"}),
        ([("", "b.c"), ("", "!b.c"), ("", "src/b.c")], {"src/b.c"}),
        ([("src", "deep")], {"src/deep/a.c", "src/deep/k.o"}),
        ([("other", "*")], set()),
        ([], set()),
    ],
)
def test_rules(spark, rules, want):
    paths = spark.createDataFrame([("r", p) for p in PATHS] + [("s", "ignored.go")], "run_id string, path string")
    told = spark.createDataFrame(
        [("r", folder, k, rule) for k, (folder, rule) in enumerate(rules)], "run_id string, folder string, line int, rule string"
    )
    got = ignored_by_rules(paths, told).collect()
    assert {r.path for r in got} == want and {r.run_id for r in got} <= {"r"} and len(got) == len(want)
