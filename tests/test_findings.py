import json
import random

from pyspark.sql import functions as F

from auditloom.functions.severity import at_or_above, normalize_severity
from auditloom.operators import findings as find

REPORTS = {
    1: ">>> HIGH: Stack overflow | long body\n>>>low:leak\n[]",
    2: 'x\n```json\n[{"severity":"critical","title":"Bad","fix":"f"},{"severity":"clean"},5,'
    '{"severity":"odd","title":" ","description":7}]\n```',
    3: "## [HIGH] Unchecked length in parser\nlength\n## Summary\noverflow\n### run() leak\n",
    4: "One medium concern",
    5: '[\n 1: {"severity":"critical","title":"A \\q"},\n 2: {"severity":"low","title":"B"}\n]',
    6: "# Critical overflow\nbuf[64] here",
    7: '{"findings":[{"severity":"informational","title":"N"}]}',
    8: "",
    9: "12abc buf[64]\n# Critical overflow",
    10: 'say { "severity" : "high", "title":"T{x}" } and {"severity":"low", "title":"u"} or { "severity": ',
    11: 'here {"a":1} high',
    12: '{"severity":null}',
    13: '{"findings":5} critical',
    14: '[{"severity":"clean","title":"ok"}] high',
    15: '```c\nint a[4];\n```\n# Heap overflow',
    16: '{"severity":"low","severity":"high","title":"twice"} and more',
    17: "éhigh",
    18: "#\n\n## Buffer race",
}
EXPECTED = {
    1: [("marker", "high", "Stack overflow", "Stack overflow | long body"), ("marker", "low", "leak", "leak")],
    2: [("json", "critical", "Bad", "\n\nFix: f"), ("json", "medium", "Untitled finding", "")],
    3: [("heading", "high", "Unchecked length in parser", "## [HIGH] Unchecked length in parser\nlength")],
    4: [("unstructured", "medium", "Unstructured finding", "One medium concern")],
    5: [("json", "critical", "A \\q", ""), ("json", "low", "B", "")],
    7: [("json", "informational", "N", "")],
    9: [("heading", "critical", "overflow", "# Critical overflow")],
    10: [("json", "high", "T{x}", ""), ("json", "low", "u", "")],
    11: [("unstructured", "high", "Unstructured finding", 'here {"a":1} high')],
    12: [("json", "medium", "Untitled finding", "")],
    13: [("unstructured", "critical", "Unstructured finding", '{"findings":5} critical')],
    16: [("json", "high", "twice", "")],
    17: [("unstructured", "high", "Unstructured finding", "éhigh")],
    18: [("heading", "medium", "## Buffer race", "#\n\n## Buffer race")],
}


def reports(spark, texts=REPORTS):
    return spark.createDataFrame(sorted(texts.items()), "id int, report string")


def test_every_tier(spark):
    got = {}
    for r in find.parse_findings(reports(spark), ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.tier, r.severity, r.title, r.body))
    assert got == EXPECTED  # 6, 8, 14 and 15 are stopped or empty: no rows


def test_counts_are_the_rows(spark):
    rows = find.parse_findings(reports(spark), ["id"])
    counts = find.severity_counts(reports(spark), ["id"])
    total = counts.agg(F.sum(F.expr("critical + high + medium + low + informational"))).first()[0]
    assert total == rows.count()
    assert counts.count() == len(REPORTS)
    top = {r.id: r.top_severity for r in find.with_top_severity(counts).collect()}
    assert (top[1], top[8], top[14], top[7]) == ("high", "clean", "clean", "informational")


def test_salvage_methods(spark):
    got = {r.id: (r.method, r.n_items) for r in find.json_salvage(reports(spark), ["id"]).collect()}
    assert got[5] == ("numbered", 2)
    assert got[10] == ("objects", 2)
    assert got[6] == ("array", 0)
    assert got[15] == ("array", 0)
    assert got[11] == ("object", 0)
    assert 9 not in got and 4 not in got


def test_long_reports_keep_every_section(spark):
    text = "\n".join(f"## Leak number {i}\n" + "word " * 20 for i in range(3000))
    frame = reports(spark, {1: text, 2: "# Crash\n" + "line\n" * 200_000})
    got = find.heading_findings(frame, ["id"]).groupBy("id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 3000), (2, 1)]


def test_generated_arrays_round_trip(spark):
    rng = random.Random(5)
    words = ["critical", "HIGH", " low ", "odd", "clean", 7, None]
    texts, expected = {}, {}
    for i in range(60):
        items = [{"severity": rng.choice(words), "title": f"t{j}"} for j in range(rng.randrange(6))]
        expected[i] = sum(1 for x in items if x["severity"] != "clean")
        body = json.dumps(items if i % 2 else {"findings": items})
        texts[i] = ("noise\n```json\n" + body + "\n```") if i % 3 else body + " trailing"
    got = dict(
        find.parse_findings(reports(spark, texts), ["id"]).groupBy("id").count().collect()
    )
    assert got == {k: v for k, v in expected.items() if v}


def test_severity_rules(spark):
    df = spark.createDataFrame([("HIGH",), ("unknown",), ("\t clean\n",), (None,)], "s string")
    assert [r[0] for r in df.select(normalize_severity(F.col("s"))).collect()] == [
        "high", "medium", "clean", "medium",
    ]
    df = spark.createDataFrame([("critical",), ("high",), ("medium",), ("clean",)], "s string")
    kept = [r.s for r in df.filter(at_or_above(F.col("s"), "high")).collect()]
    assert kept == ["critical", "high"]
    # an unknown threshold means medium
    assert df.filter(at_or_above(F.col("s"), "severe")).count() == 3
