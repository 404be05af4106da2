import pandas as pd
import pytest

from auditloom.operators import completions as comp

COLUMNS = [f.split()[0] for f in comp.RESPONSE.split(", ")]


def asked(spark, n=10):
    return spark.createDataFrame([(f"q{i:02}", "text") for i in range(n)], "request_id string, payload string").coalesce(1)


@pytest.mark.parametrize("batched", [False, True])
def test_no_request_is_asked_twice(spark, tmp_path, batched):
    log, columns = str(tmp_path / "calls"), list(COLUMNS)

    def call(one):
        with open(log, "a") as f:
            f.write(one + "\n")
        if one in ("q04", "q09"):
            raise RuntimeError(f"no {one}")
        return pd.DataFrame([[one, "yes", 1, 1, 2, 0.1, None]], columns=columns)

    def single(frame):
        return call(frame["request_id"].iloc[0])

    def many(frame):
        for one in frame["request_id"]:
            yield call(one)

    got = {r.request_id: r.error for r in comp.run_completions(asked(spark), many if batched else single, batched=batched).collect()}
    assert {k: v for k, v in got.items() if v} == {"q04": "no q04", "q09": "no q09"} and len(got) == 10
    assert sorted(open(log).read().split()) == sorted(f"q{i:02}" for i in range(10))


def test_a_batch_that_fails_as_a_whole(spark):
    def all_at_once(frame):
        raise RuntimeError("down")

    rows = comp.run_completions(asked(spark, 3), all_at_once, batched=True).collect()
    assert [r.error for r in rows] == ["down"] * 3
    left = comp.pending_requests(asked(spark, 3), spark.createDataFrame(rows, comp.RESPONSE))
    assert left.count() == 3
