"""A whole review of a small tree with a scripted model, down to its files."""

import json

import pytest
from pyspark.sql import functions as F

from auditloom.functions import fixed
from auditloom.operators import reports as rep
from auditloom.plans import review
from auditloom.sources import outputs

SCAN = {"model": "m", "context_system": "s", "scan_system": "t", "context_heading": "\n", "example": ("u", "a"), "user_template": "%s %s"}
TRIAGE = {"project": "p", "template": "P %s\n%s\n%s\n%s", "arbiter_template": "%s %s %s %s %s %d %d %s %s", "rounds": 2, "model": "m"}


def scripted():
    import pandas as pd

    def model(batch):
        payload, request = batch["payload"].iloc[0], batch["request_id"].iloc[0]
        if "json_object" in payload:
            content = '{"verdict":"VALID","reasoning":"seen","grep":"needle"}'
        elif '"assistant"' in payload:
            content = '[{"severity":"high","title":"Overrun","description":"d"},{"severity":"low","title":"L"}]' if "src/ok.c int needle" in payload else "all clean"
        else:
            content = "Briefing. GREP: needle"
        return pd.DataFrame([[request, content, 1, 1, 2, 0.25, None]], columns=[
            "request_id", "content", "prompt_tokens", "completion_tokens", "total_tokens", "elapsed_s", "error"])

    return model  # in a closure, which tasks get by value


@pytest.fixture
def repo(tmp_path):
    top = tmp_path / "repo"
    for name, data in {
        "src/ok.c": b"int needle;\n", "src/ok c": b"no", ".hidden/b.c": b"int b;\n", "ignored.go": b"package x\n", "build/o.c": b"no",
        "notes.md": b"a needle in text\n", "bin.c": b"\x00",
    }.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return top


def test_review_of_a_tree(spark, repo, tmp_path):
    rules = spark.createDataFrame([("r/1", "", 1, "ignored.go")], "run_id string, folder string, line int, rule string")
    out = tmp_path / "out"
    gate = review.review_tree(
        spark, str(out), "r/1", [str(repo)], str(repo), scripted(), scan=SCAN, triage=TRIAGE, stamp="2024-01-01_000000",
        found={"rules": rules}, fail_mode="validated",
    ).collect()
    assert [(g.should_fail, g.failures, g.exit_code) for g in gate] == [(True, 1, 1)]
    base = out / "run=r%2F1"
    names = {str(p.relative_to(base)) for p in base.rglob("*") if p.is_file()}
    assert names == {
        "summary.json", "summary.md", "pr-comment.md", "triage_survivors.md", "results.sarif", "results/src_ok.c.json",
        "results/.hidden_b.c.json", "reports/src_ok.c.md", "reports/.hidden_b.c.md", "contexts/src_ok.c.context.md",
        "contexts/.hidden_b.c.context.md", "triage/T0001_src_ok.c_Overrun.json", "triages/T0001_src_ok.c_Overrun.md",
        "findings/VULN-001_src_ok.c.md",
    }
    summary = json.loads((base / "summary.json").read_text())
    assert summary["files_scanned"] == 2 and summary["files_skipped"] == 4 and summary["should_fail"] and summary["timestamp"] == "2024-01-01_000000"
    result = json.loads((base / "results/src_ok.c.json").read_text())
    assert result["severities"]["high"] == 1 and result["total_tokens"] == 2 and result["lines"] == 1 and len(result["findings"]) == 2
    decision = json.loads((base / "triage/T0001_src_ok.c_Overrun.json").read_text())
    assert decision["confidence"] == 1.0 and [r["tokens"] for r in decision["all_rounds"]] == [2, 2]
    assert "notes.md:1:a needle in text" in (base / "triages/T0001_src_ok.c_Overrun.md").read_text()
    assert "| src/ok.c | 1 | 0 | 1 | 0 | 1 | ok |" in (base / "summary.md").read_text()
    assert "Overrun" in (base / "pr-comment.md").read_text()


def test_changed_scope(spark, repo):
    changed = spark.createDataFrame([("r", "src/ok.c"), ("r", str(repo / "build/o.c")), ("r", "gone.c")], "run_id string, path string")
    files, _ = review.discover(spark, "r", [str(repo)], str(repo), scope="changed", changed=changed)
    assert sorted(r.display_name for r in files.collect()) == ["build/o.c", "src/ok.c"]
    with pytest.raises(ValueError):
        review.discover(spark, "r", [str(repo)], str(repo), scope="some")
    with pytest.raises(ValueError):
        review.discover(spark, "r", [str(repo)], str(repo), scope="changed")


def test_colliding_names(spark):
    names = ["a/b.c", "a_b.c", "a b.c", "other.c"]
    rows = spark.createDataFrame([("r", k, n) for k, n in enumerate(names)], "run_id string, file_id int, display_name string")
    got = {r.file_id: r.slug for r in outputs.unique_slugs(rows).collect()}
    assert got == {2: "a_b.c", 0: "a_b.c~2", 1: "a_b.c~3", 3: "other.c"}


def test_pages_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(outputs, "PAGE_LINES", 10)
    rows = spark.range(25).select(F.lit("r").alias("run_id"), "id", F.concat(F.lit("l"), F.col("id").cast("string")).alias("t"))
    got = {r.path: r.content for r in outputs.pages(rows, ["id"], "t", "summary", "\n").collect()}
    assert sorted(got) == ["run=r/summary-0002.md", "run=r/summary-0003.md", "run=r/summary.md"]
    assert got["run=r/summary-0003.md"] == "\n".join(f"l{k}" for k in range(20, 25))


def test_sarif_logs_end_by_bytes(spark):
    rows = spark.range(500).select(
        F.lit("r").alias("run_id"), F.lit("high").alias("rule_id"), F.lit("error").alias("level"),
        F.concat(F.col("id").cast("string"), F.repeat(F.lit("m"), 10_000)).alias("message"), F.lit("f.c").alias("uri"),
        F.lit(1).alias("start_line"), F.lit("raw").alias("source"), F.lit(None).cast("double").alias("confidence"),
    )
    logs = rep.sarif_log(rows, "tool", shard_size=1000, shard_bytes=200_000).collect()
    assert sum(r.n_results for r in logs) == 500 and sorted(r.shard for r in logs) == list(range(len(logs)))
    assert max(len(r.sarif) for r in logs) <= 200_000 + 2 * 10_300 + 2000
    assert fixed.SARIF_SHARD_BYTES <= 64 << 20
