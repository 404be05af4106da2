import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom.functions.text import byte_prefix, safe_name, truncate_text
from auditloom.operators import ranking
from auditloom.operators import reports as rep
from auditloom.sources.sinks import parse_formats


def triage(spark, rows):
    full = [("r", i, f"f{i}.c", f"T{i}", sev, verdict, "why", conf, "V", "desc", "body") for i, (sev, verdict, conf) in enumerate(rows)]
    return spark.createDataFrame(full, "run_id string, finding_id int, file string, title string, severity string, verdict string, reasoning string, confidence double, verdicts string, description string, body string")


def raw(spark, rows):
    full = [("r", i, 0, f"f{i}.c", sev, f"T{i}", "", "", "body") for i, sev in enumerate(rows)]
    return spark.createDataFrame(full, "run_id string, file_id int, pos int, display_name string, severity string, title string, function string, description string, body string")


def test_numbers_and_sums_equal_the_window_on_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 50}", i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = ranking.numbered(df, ["g"], [F.col("v").desc(), F.col("id")], "n")
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "id")
    want = df.withColumn("n", F.row_number().over(w).cast("long"))
    assert sorted(map(tuple, got.select("g", "id", "n").collect())) == sorted(map(tuple, want.select("g", "id", "n").collect()))
    sums = ranking.running_sums(df, ["g"], [F.col("id")], {"total": "v"})
    want = df.withColumn("total", F.sum("v").over(Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, sums.select("g", "id", "total").collect())) == sorted(map(tuple, want.select("g", "id", "total").collect()))


@pytest.mark.parametrize("partitions", ["1", "50"])
def test_numbers_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(500).select((F.col("id") % 2).alias("g"), "id")
        got = ranking.numbered(df, ["g"], [F.col("id")], "n")
        assert got.filter(F.col("n") != F.expr("id div 2") + 1).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_gates(spark):
    t = triage(spark, [("high", "VALID", 0.8), ("low", "VALID", 1.0), ("critical", "INVALID", 1.0), ("critical", "VALID", 0.7)])
    failing = {r.finding_id for r in rep.gate_validated(t).collect()}
    assert failing == {0, 3}
    assert {r.finding_id for r in rep.gate_validated(t, fail_confidence=0.9).collect()} == set()
    survive = {r.finding_id for r in rep.survivors(t).collect()}
    assert failing <= survive == {0, 1, 3}
    assert [r.finding_id for r in rep.survivors(t, 0.8).orderBy("position").collect()] == [1, 0]
    findings = raw(spark, ["medium", "low"])
    assert rep.gate_raw(findings, "medium").count() == 1
    with pytest.raises(ValueError):
        rep.gate_validated(t, fail_confidence=1.5)
    runs = spark.createDataFrame([("r",), ("q",)], "run_id string")
    results = spark.createDataFrame([("r", "ok"), ("q", "error")], "run_id string, status string")
    status = {r.run_id: (r.should_fail, r.failures, r.exit_code) for r in rep.gate_status(runs, results, rep.gate_validated(t), "validated").collect()}
    assert status == {"r": (True, 2, 1), "q": (False, 0, 2)}
    never = rep.gate_status(runs, results, None, "never").filter("run_id = 'r'").first()
    assert (never.should_fail, never.exit_code) == (False, 0)
    with pytest.raises(ValueError):
        rep.gate_status(runs, results, None, "sometimes")


def test_sarif(spark):
    rows = rep.sarif_results(raw(spark, ["high", "medium", "low"]), triage(spark, [("critical", "VALID", 0.5), ("low", "INVALID", 1.0)]))
    logs = rep.sarif_log(rows, "tool", shard_size=3).orderBy("shard").collect()
    assert [r.n_results for r in logs] == [3, 1]
    every = [x for r in logs for x in json.loads(r.sarif)["runs"][0]["results"]]
    assert sorted((x["ruleId"], x["level"]) for x in every) == [("critical", "error"), ("high", "error"), ("low", "note"), ("medium", "warning")]
    valid = next(x for x in every if x["properties"]["source"] == "validated")
    assert valid["properties"]["confidence"] == 0.5 and valid["message"]["text"] == "T0: desc"
    assert "confidence" not in next(x for x in every if x["ruleId"] == "high")["properties"]
    assert len(json.loads(logs[0].sarif)["runs"][0]["tool"]["driver"]["rules"]) == 5


def test_comment_and_sections(spark):
    findings = raw(spark, ["low"] * 25)
    none = triage(spark, [("high", "INVALID", 0.0)])
    shown = rep.comment_topk(findings, none).collect()
    assert len(shown) == 20 and {(r.section, r.omitted) for r in shown} == {("raw", 5)}
    valid = triage(spark, [("high", "VALID", 0.9)])
    assert [(r.section, r.omitted) for r in rep.comment_topk(findings, valid).collect()] == [("validated", 0)]
    runs = spark.createDataFrame([("r",), ("q",)], "run_id string")
    results = spark.createDataFrame([("q", "error")], "run_id string, status string")

    def section(f, t):
        return {r.run_id: r.section for r in rep.report_section(runs, f, t, results).collect()}

    assert section(findings, valid) == {"r": "validated", "q": "errors"}
    assert section(findings, none)["r"] == "raw, none survived triage"
    assert section(findings, none.limit(0))["r"] == "raw, not triaged"
    assert section(findings.limit(0), none)["r"] == "none"


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a/b c*é.c ",), ("__",), ("x" * 200,), ("é" * 10,)], "s string")
    assert [r[0] for r in df.select(safe_name(F.col("s"))).collect()] == ["a_b_c_.c", "unnamed", "x" * 120, "unnamed"]
    assert [r[0] for r in df.select(truncate_text(F.col("s"), 100)).collect()][2] == "x" * 85 + "\n\n_[truncated]_"
    assert [r[0] for r in df.select(truncate_text(F.col("s"), 5)).collect()] == ["a/b c", "__", "xxxxx", "é" * 5]
    mixed = spark.createDataFrame([("aé€😀z",)], "s string")  # 1 + 2 + 3 + 4 + 1 bytes
    cuts = {n: mixed.select(byte_prefix(F.col("s"), n)).first()[0] for n in range(4, 12)}
    assert cuts == {4: "aé", 5: "aé", 6: "aé€", 7: "aé€", 8: "aé€", 9: "aé€", 10: "aé€😀", 11: "aé€😀z"}
    assert parse_formats(" JSON, sarif ") == ("json", "sarif")
    assert parse_formats("") == ("json", "markdown", "sarif")
