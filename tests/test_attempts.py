"""Paid calls: retries over a ledger, and what a lost task repeats."""

import datetime
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.operators import attempts
from auditloom.operators import completions as comp

COLUMNS = [f.split()[0] for f in comp.TRY.split(", ")]


def requests(spark, n):
    return spark.createDataFrame([(f"q{k:03}", "text") for k in range(n)], "request_id string, payload string")


def replies():
    columns = list(COLUMNS)  # in a closure, which tasks get by value

    def reply(one, status=200, body="", error=None):
        return pd.DataFrame([[one, "yes", 1, 1, 2, 0.1, error, status, body]], columns=columns)

    return reply


class Clock:
    def __init__(self):
        self.at, self.waits = datetime.datetime(2024, 1, 1, 12, 0, 30), []

    def now(self):
        return self.at

    def wait(self, seconds):
        self.waits.append(seconds)
        self.at += datetime.timedelta(seconds=seconds)


def settled(spark, n, model, folder, clock, **options):
    def ask(due):
        return comp.run_completions(due, model, schema=comp.TRY)

    rows = attempts.settle(
        requests(spark, n), ask, str(folder), clock=clock.now, wait=clock.wait, **options
    ).collect()
    return {r.request_id: (r.content, r.error) for r in rows}


def test_retries(spark, tmp_path):
    """429 is asked again without counting, 503 three times at most, 400 never."""
    log, reply = str(tmp_path / "calls"), replies()

    def model(frame):
        one = frame["request_id"].iloc[0]
        with open(log, "a") as f:
            f.write(one + "\n")
        tries = open(log).read().split().count(one)
        if one == "q000" and tries <= 4:
            return reply(one, 429, "Rate limit reached")
        if one == "q001" and tries <= 2:
            return reply(one, 503, "busy")
        if one == "q002":
            return reply(one, 503, "down", "api 503: down")
        if one == "q003":
            return reply(one, 400, "bad", "api 400: bad")
        if one == "q004":
            raise RuntimeError("no route")
        return reply(one)

    clock = Clock()
    got = settled(spark, 8, model, tmp_path / "tries", clock)
    assert got["q000"] == got["q001"] == got["q007"] == ("yes", None)
    assert got["q002"][1] == "api 503: down" and got["q003"][1] == "api 400: bad" and got["q004"][1] == "no route"
    calls = open(log).read().split()
    assert {q: calls.count(q) for q in set(calls)} == {
        "q000": 5, "q001": 3, "q002": 3, "q003": 1, "q004": 3, "q005": 1, "q006": 1, "q007": 1,
    }
    assert clock.waits[:2] == [2.0, 4.0] and sum(clock.waits) >= 3 * 60


def test_a_lost_task_repeats_one_batch(spark, tmp_path):
    log, mark, reply = str(tmp_path / "calls"), str(tmp_path / "died"), replies()

    def model(frame):
        one = frame["request_id"].iloc[0]
        with open(log, "a") as f:
            f.write(one + "\n")
        if one == "q050" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)  # the worker dies in the middle of its batch
        return reply(one)

    with pytest.raises(Exception):
        settled(spark, 100, model, tmp_path / "tries", Clock(), batch=5, width=2)
    got = settled(spark, 100, model, tmp_path / "tries", Clock(), batch=5, width=2)
    assert len(got) == 100 and set(got.values()) == {("yes", None)}
    calls = open(log).read().split()
    assert set(calls) == set(got) and len(calls) - 100 <= 2 * 5


def test_answers_take_the_first(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [
        ("a", "first", 1, 1, 2, 0.1, None, 200, "", 1, at),
        ("a", "second", 1, 1, 2, 0.1, None, 200, "", 2, at + datetime.timedelta(1)),
        ("b", "", 0, 0, 0, 0.0, "old", 503, "", 1, at),
        ("b", "", 0, 0, 0, 0.0, None, 503, "new", 2, at + datetime.timedelta(1)),
    ]
    tries = spark.createDataFrame(rows, attempts.LEDGER)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    got = {r.request_id: (r.content, r.error) for r in attempts.answers(asked, tries).collect()}
    assert got == {"a": ("first", None), "b": ("", "new")}


def test_nothing_to_ask(spark, tmp_path):
    assert settled(spark, 0, replies(), tmp_path / "tries", Clock()) == {}


def test_requests_do_not_pass_through_the_driver(spark, tmp_path):
    """Neither side of a join of requests and tries is broadcast, however small it looks."""
    asked = requests(spark, 50).withColumn("attempt", F.lit(1))
    asked.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    values = ", ".join(f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in comp.TRY.split(", ")[1:])
    told = asked.selectExpr("request_id", *values.split(", "))
    tries = attempts.numbered(told, asked).withColumn("tried_at", F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    left, got = attempts.backlog(asked.drop("attempt"), tries), attempts.answers(asked, tries)
    for df in (tries, left, got):
        df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert (tries.count(), left.count(), got.count()) == (50, 0, 50)  # all are answered
