from pyspark.sql import functions as F

from auditloom.operators import completions as comp
from auditloom.operators import triage as tri
from auditloom.plans.runs import review_run, scan_run, triage_run

ROUND = ["run_id", "finding_id", "round_no"]


def rounds(spark, spec):
    rows = [("r", fid, k + 1, v, f"{fid}-{k + 1}") for fid, votes in spec.items() for k, v in enumerate(votes)]
    return spark.createDataFrame(rows, "run_id string, finding_id int, round_no int, verdict string, reasoning string")


def findings(spark, ids):
    return spark.createDataFrame([("r", i, f"f{i}.c", f"T{i}", "high") for i in ids], "run_id string, finding_id int, file string, title string, severity string")


def test_votes(spark):
    votes = {1: ["VALID", "INVALID", "UNCERTAIN"], 2: ["VALID", "ERROR"], 3: ["INVALID"]}
    conf = {r.finding_id: r.confidence for r in tri.confidence(rounds(spark, votes)).collect()}
    assert conf == {1: 0.33, 2: 0.5, 3: 0.0}
    assert {r.finding_id: r.verdicts for r in tri.verdict_string(rounds(spark, votes)).collect()} == {1: "VIU", 2: "VE", 3: "I"}


def test_arbiter_counts_only_when_it_decides(spark):
    votes = {1: ["VALID", "INVALID"], 2: ["VALID", "INVALID"], 3: ["VALID", "ERROR"]}
    arbiter = rounds(spark, {1: ["VALID"], 2: ["UNCERTAIN"]}).withColumn("round_no", F.lit(3))
    got = {r.finding_id: (r.verdict, r.confidence, r.verdicts, r.reasoning) for r in tri.final_verdict(findings(spark, [1, 2, 3]), rounds(spark, votes), arbiter).collect()}
    assert got == {1: ("VALID", 0.67, "VI->V", "1-1"), 2: ("INVALID", 0.5, "VI", "2-2"), 3: ("ERROR", 0.5, "VE", "3-2")}


def test_parse_verdicts(spark):
    rows = [
        (1, '{"verdict":"valid","reasoning":"r","crux":"c","grep":"GREP: `x`"}', None),
        (2, '{"verdict":" VALID","reasoning":" "}', None),
        (3, "  Invalid: because", None),
        (4, "It is VALID", None),
        (5, "", "api 500"),
        (6, 'see buf[64] {"verdict":"VALID"}', None),
        (7, 'so {"verdict":"INVALID","reasoning":7} done', None),
        (8, "Uncertain", None),
    ]
    df = spark.createDataFrame(rows, "id int, content string, error string")
    got = {r.id: (r.verdict, r.reasoning) for r in tri.parse_verdicts(df, ["id"]).collect()}
    assert got == {
        1: ("VALID", "r\n\nCRUX: c\nGREP: x"),
        2: ("UNCERTAIN", rows[1][1]),
        3: ("INVALID", "  Invalid: because"),
        4: ("UNCERTAIN", "It is VALID"),
        5: ("ERROR", "api 500"),
        6: ("UNCERTAIN", rows[5][1]),  # the first balanced chunk is [64], not an object
        7: ("INVALID", rows[6][1]),
        8: ("UNCERTAIN", "Uncertain"),
    }


def test_order_and_tally(spark):
    votes = {1: ["INVALID"], 2: ["VALID"], 3: ["VALID"], 4: ["ERROR"]}
    none = rounds(spark, votes).limit(0)
    triage = tri.final_verdict(findings(spark, votes), rounds(spark, votes), none)
    ordered = tri.triage_order(triage).orderBy("position").collect()
    assert [r.finding_id for r in ordered] == [2, 3, 1, 4]
    runs = spark.createDataFrame([("r",), ("q",)], "run_id string")
    tally = {r.run_id: tuple(r)[1:] for r in tri.verdict_tally(runs, triage).collect()}
    assert tally == {"r": (2, 1, 0, 1), "q": (0, 0, 0, 0)}


def full_findings(spark):
    return findings(spark, [1, 2]).select(
        "*", F.lit("body").alias("body"), F.lit("int x;").alias("code"), F.lit("c" * 3000).alias("context")
    )


def test_prompts_condense_all_but_the_latest(spark):
    ev = "GREP `x`:\n```\na.c:1:x\n```"
    df = rounds(spark, {1: ["VALID"] * 3}).withColumn("evidence", F.lit(ev))
    got = {r.round_no: r for r in tri.round_prompts(full_findings(spark), df, "P %s\n%s\n%s\n%s", "p").collect()}
    assert got[1].n_prior == 0 and "Reviewer" not in got[1].prompt
    assert got[1].prompt.count("c" * 2000) == 1 and "c" * 2001 not in got[1].prompt
    third = got[3].prompt
    assert "**Reviewer 1**:\n1-1\n\n[Prior grep evidence]:\n" in third
    assert "**Reviewer 2**:\n1-2\n\n[GREP RESULTS]:\nGREP `x`" in third


def test_triage_run_with_a_scripted_model(spark):
    import pandas as pd

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        def reply(text: str) -> str:
            return '{"verdict":"VALID","reasoning":"seen %d","grep":"needle"}' % text.count("**Reviewer")

        return pd.DataFrame({
            "request_id": batch["request_id"], "content": batch["payload"].map(reply),
            "prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2, "elapsed_s": 0.1, "error": None,
        })

    lines = spark.createDataFrame([("r", "n.h", 3, "a needle here")], "run_id string, path string, line int, text string")
    decided, done = triage_run(
        full_findings(spark), lines, model, project="p", template="P %s\n%s\n%s\n%s",
        arbiter_template="%s %s %s %s %s %d %d %s %s", rounds=2,
    )
    got = {r.finding_id: (r.verdict, r.confidence, r.verdicts) for r in decided.collect()}
    assert got == {1: ("VALID", 1.0, "VV->V"), 2: ("VALID", 1.0, "VV->V")}
    told = {(r.finding_id, r.round_no): r for r in done.collect()}
    assert told[1, 2].reasoning == "seen 1\nGREP: needle"
    assert told[1, 1].grep_used and "n.h:3:a needle here" in told[1, 1].evidence


def test_rounds_read_the_lines_once(spark):
    import pandas as pd

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        payload = batch["payload"].iloc[0]
        word = ("needle", "hay", "needle", "stack", "hay")[payload.count("**Reviewer") % 5]
        content = '{"verdict":"VALID","reasoning":"seen","grep":"%s"}' % word
        return pd.DataFrame([[batch["request_id"].iloc[0], content, 1, 1, 2, 0.1, None]], columns=[
            "request_id", "content", "prompt_tokens", "completion_tokens", "total_tokens", "elapsed_s", "error"])

    rows = [("r", f"n{k}.h", 3, f"a {w} here") for k, w in enumerate(["needle", "hay", "stack", "other"])]
    schema = "run_id string, path string, line int, text string"
    lines = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    _, done = triage_run(
        full_findings(spark), lines, model, project="p", template="P %s\n%s\n%s\n%s",
        arbiter_template="%s %s %s %s %s %d %d %s %s", rounds=5,
    )
    told = done.collect()
    assert {r.round_no for r in told} == {1, 2, 3, 4, 5} and all(r.grep_used for r in told)
    assert read.value == len(rows)


def test_scan_run_with_a_scripted_model(spark):
    import pandas as pd

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        def reply(payload: str) -> str:
            if "bad.c" in payload and "Briefing" not in payload:
                raise RuntimeError("no briefing")
            return "Briefing. GREP: needle" if "assistant" not in payload else '[{"severity":"high","title":"T"}]'

        content = batch["payload"].map(reply)
        return pd.DataFrame({
            "request_id": batch["request_id"], "content": content, "prompt_tokens": 1,
            "completion_tokens": 1, "total_tokens": 2, "elapsed_s": 0.25, "error": None,
        })

    files = spark.createDataFrame([("r", 1, "ok.c", "int a;"), ("r", 2, "bad.c", "int b;")], "run_id string, file_id int, display_name string, content string")
    lines = spark.createDataFrame([("r", "ok.c", 1, "needle")], "run_id string, path string, line int, text string")
    results, found = scan_run(
        files, lines, model, model="m", context_system="s", scan_system="t", context_heading="\n",
        example=("u", "a"), user_template="%s %s", retry={"max_attempts": 1},
    )
    rows = {r.display_name: r for r in results.collect()}
    assert rows["ok.c"].status == "ok" and "ok.c:1:needle" in rows["ok.c"].context
    assert rows["ok.c"].total_elapsed == 0.5 and rows["ok.c"].context_elapsed == 0.3
    assert (rows["bad.c"].status, rows["bad.c"].error, rows["bad.c"].context) == ("error", "no briefing", "")
    assert [(r.display_name, r.severity) for r in found.collect()] == [("ok.c", "high")]


def test_calls_and_backlog(spark):
    rows = [
        (1, "2024-01-01 00:00:10", 429, ""), (1, "2024-01-01 00:01:20", 503, "busy"),
        (2, "2024-01-01 00:00:10", 200, "fine"), (3, "2024-01-01 00:00:10", 400, "bad"),
        (4, "2024-01-01 00:00:10", 429, "insufficient_quota"), (5, "2024-01-01 00:00:30", 200, "Rate limit reached"),
        (6, "2024-01-01 00:00:00", 500, ""), (6, "2024-01-01 00:00:00", 500, ""), (6, "2024-01-01 00:00:01", 500, ""),
        (7, "2024-01-01 00:00:00", 429, "odd text"),
    ]
    calls = spark.createDataFrame(rows, "request_id int, ts string, status_code int, body string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    classes = [r["class"] for r in comp.classify_calls(calls).collect()]
    assert classes == ["rate_limited", "retryable", "ok", "fatal", "retryable", "rate_limited", "retryable", "retryable", "retryable", "retryable"]
    backlog = {r.request_id: (r.attempts, str(r.eligible_at)) for r in comp.retry_backlog(calls).collect()}
    assert backlog == {
        1: (1, "2024-01-01 00:01:22"), 4: (1, "2024-01-01 00:00:12"),
        5: (0, "2024-01-01 00:01:00"), 7: (1, "2024-01-01 00:00:02"),
    }


def test_decoding(spark):
    bodies = [
        '{"choices":[{"message":{"content":"","reasoning_content":"why"}}],"usage":{"total_tokens":3}}',
        '{"choices":[{"message":{"content":"a"}}]} trailing', '{"error":{"code":1},"choices":[{"message":{"content":"a"}}]}',
        '{"choices":[]}', '{"choices":5}', '{"error":null,"choices":[{"message":{"content":"a"}},{"message":{"content":"b"}}]}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = [(r.content, r.total_tokens, r.error) for r in comp.decode_completions(df).orderBy("id").collect()]
    assert got == [
        ("why", 3, None), (None, None, "invalid response"), (None, None, 'api error: {"code":1}'),
        (None, None, "api response contained no choices"), (None, None, "invalid response"), ("a", 0, None),
    ]


def test_pending_requests(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    stored = spark.createDataFrame([("a", None), ("b", "api 500")], "request_id string, error string")
    assert sorted(r.request_id for r in comp.pending_requests(asked, stored).collect()) == ["b", "c"]


def test_finding_text_falls_back(spark):
    rows = [("high", "T", "b", "d", "f.c"), ("high", "T", "", "d", "f.c"), ("high", "T<x>", "", "", "f.c"), ("high", "T", "", None, "")]
    df = spark.createDataFrame(rows, "severity string, title string, body string, description string, file string")
    got = [r[0].split("\n\n", 1)[1] for r in df.select(tri.finding_text(df)).collect()]
    assert got == ["b", "d", '{"severity":"high","title":"T\\u003cx\\u003e","file":"f.c"}', '{"severity":"high","title":"T"}']


def test_a_whole_run_and_its_second_start(spark, tmp_path):
    import pandas as pd

    log = str(tmp_path / "calls")

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        payload, request = batch["payload"].iloc[0], batch["request_id"].iloc[0]
        with open(log, "a") as f:
            f.write(request + "\n")
        if "json_object" in payload:
            content = '{"verdict":"VALID","reasoning":"seen","grep":"needle"}'
        elif '"assistant"' in payload:
            content = '[{"severity":"high","title":"T","description":"d"},{"severity":"low","title":"L"}]'
        else:
            content = "Briefing. GREP: needle"
        return pd.DataFrame([[request, content, 1, 1, 2, 0.25, None]], columns=[
            "request_id", "content", "prompt_tokens", "completion_tokens", "total_tokens", "elapsed_s", "error"])

    files = spark.createDataFrame([("r", 1, "ok.c", "int a;"), ("r", 2, "b.c", "int b;")], "run_id string, file_id int, display_name string, content string")
    lines = spark.createDataFrame([("r", "ok.c", 1, "needle")], "run_id string, path string, line int, text string")

    def start():
        results, found, decided, rounds = review_run(
            files, lines, model, answers=str(tmp_path / "answers"),
            scan={"model": "m", "context_system": "s", "scan_system": "t", "context_heading": "\n", "example": ("u", "a"), "user_template": "%s %s"},
            triage={"project": "p", "template": "P %s\n%s\n%s\n%s", "arbiter_template": "%s %s %s %s %s %d %d %s %s", "rounds": 2, "model": "m", "system": "judge"},
        )
        assert found.count() == 4 and results.filter("status = 'ok'").count() == 2
        assert {r.evidence is not None for r in rounds.collect()} == {True}
        assert {(r.tokens, r.elapsed_s) for r in rounds.collect()} == {(2, 0.3)}
        return sorted((r.file, r.title, r.verdict, r.verdicts) for r in decided.collect())

    want = [("b.c", "T", "VALID", "VV->V"), ("ok.c", "T", "VALID", "VV->V")]
    assert start() == want
    calls = open(log).read().split()
    assert len(calls) == len(set(calls)) == 2 + 2 + 2 * 3
    assert start() == want
    assert open(log).read().split() == calls
