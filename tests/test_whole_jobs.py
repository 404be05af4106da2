"""Queries over tables of their own: whole jobs, and forms that must not grow faster than the input."""

import hashlib
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from auditloom.operators import evidence as ev
from auditloom.operators import findings as find
from auditloom.operators import ignore_rules
from auditloom.plans import registry
from auditloom.session import CLEAN_UP, scratch_dir
from auditloom.sources import outputs

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, documents):
    rows = [(k, text, "en", run, len(text)) for k, (run, text) in enumerate(documents)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return rows


def test_corpus_scan_reads_every_file(spark, tmp_path):
    """Any directory, extension and size; the eight directories and seven extensions take turns."""
    rows = tables(spark, tmp_path, [("r", f"text {k} " * (1 if k % 3 else 900)) for k in range(56)])
    got = registry.queries()["corpus_scan"](spark, str(tmp_path)).collect()
    assert len(got) == 56 + 12 + 1  # hidden copies of every fifth, one file that is a root
    # every 29th file ends in a zero byte
    whole = [(k, (text + "\0" * (k % 29 == 0)).encode()) for k, text, *_ in rows]
    want = sorted(hashlib.sha256(data).hexdigest() for k, data in whole for _ in range(1 + (k % 5 == 0) + (k == 0)))
    assert sorted(r.digest for r in got) == want


def lines_of(spark, n):
    rows = []
    for run in ("r", "q"):
        for k in range(n):
            text = f"the line {k} of the corpus" + ("  #define the" if k % 97 == 0 else "") + (" é" if k % 5 == 0 else "")
            rows.append((run, f"d{k % 7}/f{k // 3}.{'h' if k % 11 == 0 else 'c'}", k, text))
    rows.append(("r", "long.c", 1, "x y" * 3000 + " the end of a long line"))
    return rows, spark.createDataFrame(rows, "run_id string, path string, line int, text string")


def test_matches_are_not_shuffled(spark):
    rows, lines = lines_of(spark, 500)
    asked = ["the", "e", "é", " ", "f the corpus", "end of a long line", "xx", "yx y", "none here", "the end"]
    patterns = spark.createDataFrame([("r", p) for p in asked] + [(None, "the")], "run_id string, pattern string")
    found = ev.corpus_search(lines, patterns)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((p, path, line) for run, path, line, text in rows if run == "r" for p in asked if p in text)
    assert sorted((r.pattern, r.path, r.line) for r in found.collect()) == want


def test_patterns_in_blocks(spark, monkeypatch):
    rows, lines = lines_of(spark, 60)
    asked = [(run, p) for run in "rq" for p in ("the", "line 1", "e 2", "corpus", "of the corpus")]
    patterns = spark.createDataFrame(asked, "run_id string, pattern string")
    want = sorted((run, p, path, line) for run, path, line, text in rows for r, p in asked if r == run and p in text)
    for most in (150, 400):  # a run in several blocks, a run a block
        monkeypatch.setattr(ev, "BROADCAST_BYTES", most)
        found = ev.corpus_search(lines, patterns).collect()
        assert sorted((r.run_id, r.pattern, r.path, r.line) for r in found) == want


def test_first_matches_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ev, "RANGE_BYTES", 1 << 10)
    _, lines = lines_of(spark, 600)
    asked = ["the", "line 1", "é", "#define", "corpus  #d", "line 599", "none here"]
    patterns = spark.createDataFrame([(run, p) for run in "rq" for p in asked], "run_id string, pattern string")
    columns = ["run_id", "pattern", "rn", "path", "line", "text"]
    want = ev.top_matches(ev.corpus_search(lines, patterns)).select(*columns).collect()
    assert sorted(ev.first_matches(lines, patterns).select(*columns).collect()) == sorted(want)


def test_rules_that_stand_again_are_met_once(spark):
    texts = ["*3.c", "!f*[13].?", "lib", "/src/net/", "x[a/b]", "**/docs/**", "fo\\o.c", "!src/**/f*3.go"]
    rules = spark.createDataFrame([("r", "", k, texts[k % 8]) for k in range(400)], "run_id string, folder string, line int, rule string")
    known = ignore_rules.standing(ignore_rules.parsed_rules(rules))
    assert {(r.line, r.key) for r in known.collect()} == {
        (392, "e3.c"), (393, "sf"), (394, "elib"), (395, "enet"), (396, ""), (397, ""), (398, ""), (399, "e.go")
    }
    names = ["a3.c", "f3.c", "f33.go", "src/net/a", "src/x/f3.go", "lib/a", "docs/a/b", "foo.c", "xa", "other", "f1.c"]
    paths = spark.createDataFrame([("r", n) for n in names], "run_id string, path string")
    got = {r.path for r in ignore_rules.ignored_by_rules(paths, rules).collect()}
    assert got == {"a3.c", "src/net/a", "lib/a", "docs/a/b", "foo.c", "xa"}


def test_results_and_findings_of_one_parse(spark, monkeypatch):
    """The same rows as parsing twice, also of repeated and null rows, and without reading the texts twice."""
    texts = [">>> HIGH: A | x\n>>> low: B", "", None, "One medium concern.", "nothing", '[{"severity":"low","title":"t"},5]', "## [HIGH] Bad overflow\nx"]
    rows = [("r" if k % 3 else None, k // 2, f"n{k}", t, "ok") for k, t in enumerate(texts * 2)]
    columns = "run_id string, file_id int, display_name string, report string, status string"
    reports = spark.createDataFrame(rows + rows[:3], columns)
    keys = ["run_id", "file_id", "display_name"]
    counts, found = find.parse_and_count(reports, keys, ["status"])
    for got, want in (
        (counts, find.severity_counts(reports, [*keys, "status"])),
        (found, find.parse_findings(reports, keys)),
    ):
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    parsed, tier = [], find.with_tier
    monkeypatch.setattr(find, "with_tier", lambda *a, **k: parsed.append(1) or tier(*a, **k))
    assert registry.queries()["comment_page"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(parsed) == 1


def test_evidence_by_turns(spark, monkeypatch):
    """In turns or at once the same, also by finding; what comes out is read from storage and shuffled no more."""
    _, lines = lines_of(spark, 60)
    asked = [(run, k // 3, k % 3, f"look\nGREP: line {k}|of the corpus\nplease grep for \"the end\"") for run in "rq" for k in range(12)]
    asked += [("r", 1, 2, "GREP: line 5"), (None, 7, 1, "GREP: corpus"), ("r", None, 1, "GREP: corpus"), ("q", 9, 1, "nothing")]
    reviews = spark.createDataFrame(asked, "run_id string, finding_id int, round_no int, reasoning string")
    keys = ["run_id", "finding_id", "round_no"]
    requested = ev.clean_patterns(reviews, keys, "reasoning")
    top = ev.top_matches(ev.corpus_search(lines, requested))
    want = sorted(map(str, ev.evidence_blocks(requested, ev.pattern_blocks(requested, top), keys).collect()))
    together = []

    def finish(mine, evidence, of_turn):
        together.append({(r.run_id, r.finding_id) for r in of_turn(mine).collect()})
        return mine.join(evidence, keys, "left").groupBy(*keys[:2]).agg(F.count("evidence").alias("n"), F.count("*").alias("m"))

    counts = None
    for most in (1 << 30, 500):
        monkeypatch.setattr(ev, "TURN_BYTES", most)
        got = ev.gather_evidence(reviews, lines, keys, "reasoning")
        assert sorted(map(str, got.collect())) == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        together.clear()
        found = sorted(map(str, ev.gather_evidence(reviews, lines, keys, "reasoning", keys[:2], finish).collect()))
        assert len(together) == (1 if most > 500 else ev.MAX_TURNS)
        assert sum(map(len, together)) == len(set().union(*together)) == len(found) == 11
        assert counts in (None, found)
        counts = found


def stored_columns(spark):
    """Columns of each table in the scratch folder, by name."""
    folders = Path(scratch_dir(spark).removeprefix("file:")).glob("kept-*")
    return {f.name: set(spark.read.parquet(str(f)).columns) for f in folders if any(f.glob("*.parquet"))}


def test_turns_move_no_lines_and_leave_none(spark, monkeypatch):
    """A turn shuffles places, not the lines; when the turns are over no copy of the lines is left."""
    monkeypatch.setattr(ev, "RANGE_BYTES", 1 << 10)
    monkeypatch.setattr(ev, "TURN_BYTES", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    _, lines = lines_of(spark, 60)
    lines = lines.unionByName(lines.limit(1).withColumn("text", F.concat(F.lit("\0é" * 900), F.lit("a seldom word\0"), F.lit("€" * 400))))
    asked = [("r", k, f"GREP: line {k}|of the corpus\nplease grep for \"seldom word\"") for k in range(6)]
    reviews = spark.createDataFrame(asked, "run_id string, finding_id int, reasoning string")
    keys = ["run_id", "finding_id"]
    requested = ev.clean_patterns(reviews, keys, "reasoning")
    top = ev.top_matches(ev.corpus_search(lines, requested))
    want = sorted(map(str, ev.evidence_blocks(requested, ev.pattern_blocks(requested, top), keys).collect()))
    assert "€..." in want[0]
    before, plans = set(stored_columns(spark)), []

    def finish(mine, evidence, of_turn):
        plans.append(evidence._jdf.queryExecution().executedPlan().toString())
        return evidence

    try:
        got = ev.gather_evidence(reviews, lines, keys, "reasoning", finish=finish)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, got.collect())) == want
    assert plans and all(p.count("Exchange hashpartitioning(_place") == 1 for p in plans)
    left = {name: c for name, c in stored_columns(spark).items() if name not in before}
    assert not [name for name, c in left.items() if "text" in c or "_place" in c and "path" in c]


def test_run_files_are_written_table_by_table(spark, monkeypatch):
    """Each table is a write of its own, with its clean-up; neither lines nor documents of decisions stay stored."""
    written, write = [], outputs.write_files

    def one(rows, folder):
        written.append(rows)
        write(rows, folder)

    monkeypatch.setattr(outputs, "write_files", one)
    before = set(stored_columns(spark))
    got = registry.queries()["run_files"](spark, "/root/testdata/sf0.001")
    names = {r.path.split("/")[1] for r in got.collect()}
    assert names == {"triages", "findings", "reports", "contexts", "summary.md", "summary.json", "pr-comment.md", "triage_survivors.md"}
    assert len(written) == 11  # three of JSON, seven of Markdown, SARIF
    assert spark.conf.get(CLEAN_UP, "false") == "false"
    left = [c for name, c in stored_columns(spark).items() if name not in before]
    assert not [c for c in left if {"kind", "text"} <= c or {"path", "line", "text"} <= c]


def test_search_meets_one_number_and_reads_a_line_for_what_stands_there(spark):
    """The run is no key of the join, and a gram at each place of a long line costs no search of the line."""
    long = "abc bcd é" * 60_000 + "zabcdz" + "abcd" * 3
    rows = [("r", "a.c", 1, long), ("r", "b.c", 2, long[:-18] + "é"), ("q", "a.c", 3, "é\U0001f600bcd"), ("q", "b.c", 4, None)]
    lines = spark.createDataFrame(rows, "run_id string, path string, line int, text string")
    asked = [(run, p) for run in "rq" for p in ("abcd", "bcd éa", "é", "éé", "\U0001f600b", "c", "cd", "abcdabcd", "dz", " bcd ébc")]
    patterns = spark.createDataFrame(asked + [(None, "abc"), ("r", None), ("r", "")], "run_id string, pattern string")
    found = ev.corpus_search(lines, patterns)
    began = time.monotonic()
    got = sorted((r.run_id, r.pattern, r.line) for r in found.select("run_id", "pattern", "line").collect())
    assert time.monotonic() - began < 30
    assert got == sorted((run, p, line) for run, _, line, text in rows for r, p in asked if r == run and p in (text or ""))
    keys = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert keys and not [k for k in keys if "," in k]
