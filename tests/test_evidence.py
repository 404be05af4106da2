import random

import pytest
from pyspark.sql import functions as F

from auditloom import session
from auditloom.operators import evidence as ev
from auditloom.operators.search_index import SearchIndex


def reviews(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, reasoning string")


def patterns_of(spark, text):
    rows = ev.clean_patterns(reviews(spark, [text]), ["id"]).orderBy("pos").collect()
    return [r.pattern for r in rows]


def test_requests_and_cleaning(spark):
    assert patterns_of(spark, "GREP: parse_len|MAX_LEN\nnothing") == ["parse_len", "MAX_LEN"]
    assert patterns_of(spark, 'please grep for "read_buf" now') == ["read_buf"]
    assert patterns_of(spark, "grep for short and grep for long_enough(") == ["long_enough("]
    assert patterns_of(spark, "GREP: src/a.c: real_name") == ["real_name"]
    assert patterns_of(spark, "GREP: 1234:") == []
    assert patterns_of(spark, "GREP: results|ab|`quoted_name`") == ["quoted_name"]
    assert patterns_of(spark, r"GREP: \bmemcpy\(") == ["memcpy("]
    assert patterns_of(spark, "GREP: alpha, session_state->buffer, verification") == [
        "session_state->buffer"
    ]
    # the text may follow on the next line; only three requests count
    assert patterns_of(spark, "GREP:\n  wrapped\nGREP: one1\nGREP: two2\nGREP: four") == [
        "wrapped", "one1", "two2",
    ]
    assert len(patterns_of(spark, "GREP: aa1|bb2|cc3|dd4|ee5|ff6|gg7|hh8")) == 6
    assert patterns_of(spark, "no request") == []


def corpus(spark, seed=3):
    rng = random.Random(seed)
    alphabet = "abcé #"
    rows = [
        (f"r{rng.randrange(2)}", f"p{i}.{'h' if i % 3 else 'c'}", 1, "".join(rng.choices(alphabet, k=rng.randrange(60))))
        for i in range(120)
    ]
    pats = [(f"r{rng.randrange(2)}", "".join(rng.choices(alphabet, k=k))) for k in (1, 2, 3, 3, 4, 5, 6, 8, 9, 12) for _ in range(4)]
    lines = spark.createDataFrame(rows, "run_id string, path string, line int, text string")
    patterns = spark.createDataFrame(pats, "run_id string, pattern string")
    brute = {(a, p, path) for a, p in pats for b, path, _, t in rows if a == b and p in t}
    return lines, patterns, brute


@pytest.mark.parametrize("long_word", [64, 4])
def test_search_matches_brute_force(spark, monkeypatch, long_word):
    monkeypatch.setattr(ev, "LONG_WORD", long_word)
    for seed in (3, 4):
        lines, patterns, brute = corpus(spark, seed)
        found = ev.corpus_search(lines, patterns).collect()
        got = [(r.run_id, r.pattern, r.path) for r in found]
        assert len(got) == len(set(got))
        assert set(got) == brute


def test_search_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    lines, patterns, brute = corpus(spark)
    assert {(r.run_id, r.pattern, r.path) for r in ev.corpus_search(lines, patterns).collect()} == brute


def moved_text(df):
    """Bytes that go through exchanges which carry a line's text, in the plan that ran."""
    total = 0

    def walk(plan):
        nonlocal total
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if "Exchange" in name and "text#" in plan.output().mkString(","):
            total += plan.metrics().apply("dataSize").value()
        children = plan.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return total


@pytest.mark.parametrize("n_patterns", [1400, 60_000])
def test_text_moves_once(spark, n_patterns):
    """However many patterns there are, no more than twice the corpus' text goes through a shuffle."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(4000)]
    rows = [("r", f"f{k}.c", 1, " ".join(rng.choices(words, k=40))) for k in range(2000)]
    lines = spark.createDataFrame(rows, "run_id string, path string, line int, text string")
    texts = [t for *_, t in rows]
    pats = set()
    while len(pats) < n_patterns:
        t = rng.choice(texts)
        at = rng.randrange(len(t) - 12)
        pats.add(("r", t[at : at + rng.randrange(3, 12)]))
    patterns = spark.createDataFrame(sorted(pats), "run_id string, pattern string")
    found = ev.corpus_search(lines, patterns)
    n = len(found.select("pattern").toPandas()) if n_patterns > 2000 else len(found.collect())
    assert n >= n_patterns
    again = ev.corpus_search(lines, patterns)
    again._jdf.queryExecution().toRdd().count()
    assert moved_text(again) <= 2 * sum(len(t) + 64 for t in texts)


def test_index_answers_like_a_search(spark):
    lines, patterns, _ = corpus(spark)
    index = SearchIndex(lines, buckets=3)
    want = sorted(map(tuple, ev.top_matches(ev.corpus_search(lines, patterns)).select("run_id", "pattern", "rn", "path").collect()))
    first = patterns.filter("length(pattern) < 4")
    index.look_up(first)
    assert index.look_up(patterns).join(first, ["run_id", "pattern"], "left_semi").count() == 0
    assert index.look_up(patterns).count() == 0
    got = index.found().filter("path IS NOT NULL").select("run_id", "pattern", "rn", "path").collect()
    assert sorted(map(tuple, got)) == want
    assert index.found().select("run_id", "pattern").distinct().count() == patterns.distinct().count()


def test_postings_are_not_shuffled(spark):
    lines, patterns, _ = corpus(spark)
    index = SearchIndex(lines, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = index.places.join(patterns.withColumnRenamed("pattern", "word"), ["run_id", "word"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


def test_search_runs_no_python(spark):
    lines, patterns, _ = corpus(spark)
    plan = ev.corpus_search(lines, patterns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_no_patterns(spark):
    lines, patterns, _ = corpus(spark)
    none = patterns.filter("false")
    assert ev.corpus_search(lines, none).count() == 0


def test_top_matches_order_and_bound(spark):
    rows = [("r", "x", f"f{i:03}.c", 1, "x") for i in range(50)]
    rows += [("r", "x", "z.h", 2, "x"), ("r", "x", "zz.c", 9, "#define x 1")]
    df = spark.createDataFrame(rows, "run_id string, pattern string, path string, line int, text string")
    top = ev.top_matches(df).orderBy("rn").collect()
    assert len(top) == 30
    assert [r.path for r in top[:3]] == ["zz.c", "z.h", "f000.c"]


def test_blocks_and_long_lines(spark):
    text = "é" * 1500  # 3000 bytes
    lines = spark.createDataFrame(
        [("r", "a.c", 7, text), ("r", "b.c", 1, "none")], "run_id string, path string, line int, text string"
    )
    asks = spark.createDataFrame(
        [("r", 1, "GREP: ééé\nGREP: absent")], "run_id string, finding_id int, reasoning string"
    )
    got = ev.gather_evidence(asks, lines, ["run_id", "finding_id"], "reasoning").first().evidence
    cut = "é" * 1000 + "..."
    assert got == f"GREP `ééé`:\n```\na.c:7:{cut}\n```\n\nGREP `absent`:\n```\n(no matches in repo)\n```"


def test_condense(spark):
    body = "why\n\n[GREP RESULTS]:\nGREP `x`:\n```\n" + "\n".join(f"a.c:{i}:t" for i in range(9)) + "\n```"
    empty = "why\n\n[GREP RESULTS]:\n```"
    misses = "w\n\n[GREP RESULTS]:\n" + "\n".join(["(no matches in repo)"] * 8 + ["a:1:b", "c:2:d"])
    got = [
        r[0]
        for r in reviews(spark, [body, empty, "plain", misses])
        .select(ev.condense_evidence(F.col("reasoning")))
        .collect()
    ]
    assert got[0] == "why\n\n[Prior grep evidence]:\n- [GREP RESULTS]:\n" + "\n".join(f"- a.c:{i}:t" for i in range(5))
    assert got[1] == "why\n\n[Prior grep evidence]:\n- [GREP RESULTS]:"
    assert got[2] == "plain"
    # missing-match notes never close the list
    assert got[3].count("(no matches") == 8 and got[3].endswith("- a:1:b")
