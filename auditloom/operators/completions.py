"""Batch completions: request rows, responses, retries, and one row per scanned file.

The model is a table: requests are written, somebody answers them, responses are
joined back on ``request_id``.  ``run_completions`` is the plug-in point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import digest_id, half_up

MESSAGES = "array<struct<role:string,content:string>>"
RESPONSE = (
    "request_id string, content string, prompt_tokens int, completion_tokens int, "
    "total_tokens int, elapsed_s double, error string"
)

#: A response and how the call ended; a function that does not say is judged by its error.
TRY = f"{RESPONSE}, status_code int, body string"


def _messages(*pairs: tuple[str, Column]) -> Column:
    return F.array(
        *[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in pairs]
    )


def _request(
    df: DataFrame,
    keys: list[str],
    stage: str,
    model: str,
    messages: Column,
    json_mode: bool = False,
    effort: str | None = None,
) -> DataFrame:
    """Request rows with their wire payload; optional fields are absent when unset."""
    body = [F.col("messages"), F.lit(model).alias("model")]
    if effort:
        body.append(F.lit(effort).alias("reasoning_effort"))
    if json_mode:
        body.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return (
        df.select(
            *keys,
            digest_id(F.lit(stage), *[F.col(k) for k in keys]).alias("request_id"),
            F.lit(stage).alias("stage"),
            F.lit(model).alias("model"),
            messages.cast(MESSAGES).alias("messages"),
            F.lit(json_mode).alias("json_mode"),
            F.lit(effort).cast("string").alias("reasoning_effort"),
        )
        .withColumn("payload", F.to_json(F.struct(*body)))
    )


def context_requests(files: DataFrame, system: str, model: str) -> DataFrame:
    """File → two messages: instructions, then name and fenced content."""
    user = F.format_string(fixed.FILE_MESSAGE, "display_name", "content")
    return _request(
        files, ["run_id", "file_id"], "context", model, _messages(("system", F.lit(system)), ("user", user))
    )


def scan_requests(
    files: DataFrame,
    contexts: DataFrame,
    system: str,
    context_heading: str,
    example: tuple[str, str],
    user_template: str,
    model: str,
) -> DataFrame:
    """File ⋈ context → four messages, with one worked example in between."""
    joined = files.join(contexts.select("run_id", "file_id", "context"), ["run_id", "file_id"])
    messages = _messages(
        ("system", F.concat(F.lit(system + context_heading), "context")),
        ("user", F.lit(example[0])),
        ("assistant", F.lit(example[1])),
        ("user", F.format_string(user_template, "display_name", "content")),
    )
    return _request(joined, ["run_id", "file_id"], "scan", model, messages)


def triage_requests(
    prompts: DataFrame, keys: list[str], stage: str, system: str, model: str
) -> DataFrame:
    """Prompt of a round or of the arbiter → instructions and prompt, answered as JSON."""
    messages = _messages(("system", F.lit(system)), ("user", F.col("prompt")))
    return _request(prompts, keys, stage, model, messages, json_mode=True)


def run_completions(
    requests: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame | Iterable[pd.DataFrame]],
    concurrency: int | None = None,
    batched: bool = False,
    schema: str = RESPONSE,
) -> DataFrame:
    """Answer requests with a user function; no answered request is asked again.

    ``fn`` takes one request as a frame of one row and returns its response row; an
    exception becomes that row's error.  With ``batched`` it takes many requests and
    yields response rows as they come: when it raises, the first request without an
    answer gets the error and the function goes on with those after it.  A batched
    function that returns all rows at once and raises leaves the error on all of them.
    ``concurrency`` caps how many batches run at the same time.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def shaped(frame: pd.DataFrame) -> pd.DataFrame:
        """With the columns in order; those that the function leaves out are null."""
        return frame.assign(**{n: None for n in names if n not in frame.columns})[names]

    def failed(rows: pd.DataFrame, error: Exception) -> pd.DataFrame:
        return shaped(
            pd.DataFrame([[i, "", 0, 0, 0, 0.0, str(error)] for i in rows["request_id"]], columns=names[:7])
        )

    def ask(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        while len(part):
            try:
                found = fn(part)
            except Exception as error:
                yield failed(part, error)
                return
            try:
                for frame in [found] if isinstance(found, pd.DataFrame) else found:
                    yield shaped(frame)
                    part = part[~part["request_id"].isin(frame["request_id"])]
                return
            except Exception as error:
                yield failed(part.iloc[:1], error)
                part = part.iloc[1:]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batched:
                yield from ask(batch)
            else:
                for at in range(len(batch)):
                    yield from ask(batch.iloc[at : at + 1])

    spread = requests if concurrency is None else requests.repartition(concurrency)
    return spread.mapInPandas(answer, schema)


def pending_requests(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests without a stored answer: what a restarted run still has to ask."""
    answered = stored.filter(F.col("error").isNull()).select("request_id")
    return requests.join(answered, "request_id", "left_anti")


def replay_completions(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Answer requests from recorded responses."""
    found = requests.select("request_id").join(responses, "request_id", "left")
    missing = F.col("content").isNull() & F.col("error").isNull()
    return found.withColumn(
        "error", F.when(missing, F.lit("no recorded response")).otherwise(F.col("error"))
    )


def decode_completions(calls: DataFrame, body: str = "body") -> DataFrame:
    """Wire body → content, token counts, or an error."""
    answer = (
        "choices: array<struct<message: struct<content: string, reasoning_content: string>>>, "
        "usage: struct<prompt_tokens: int, completion_tokens: int, total_tokens: int>, "
        "error: string"
    )
    # read as a member of an outer object, so that anything after the value is an error
    outer = F.concat(F.lit('{"w":'), body, F.lit("}"))
    wire = F.from_json(
        outer, f"w struct<{answer}>, broken string", {"columnNameOfCorruptRecord": "broken"}
    )
    df = (
        calls.withColumn("_outer", wire)
        .withColumn("_broken", F.col("_outer.broken").isNotNull())
        .withColumn("_wire", F.col("_outer.w"))
    )
    message = F.get("_wire.choices", F.lit(0))["message"]
    content = F.coalesce(
        F.when(message["content"] != "", message["content"]), message["reasoning_content"], F.lit("")
    )
    error = (
        F.when(F.col("_broken"), F.lit("invalid response"))
        .when(F.col("_wire.error").isNotNull(), F.concat(F.lit("api error: "), "_wire.error"))
        .when(
            F.coalesce(F.size("_wire.choices"), F.lit(0)) <= 0,
            F.lit("api response contained no choices"),
        )
    )

    def tokens(name: str) -> Column:
        return F.when(error.isNull(), F.coalesce(F.col(f"_wire.usage.{name}"), F.lit(0))).alias(name)

    return df.select(
        *calls.columns,
        F.when(error.isNull(), content).alias("content"),
        *[tokens(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")],
        error.alias("error"),
    )


def call_class(status: Column, body: Column) -> Column:
    """rate_limited, retryable, fatal or ok."""
    text = F.lower(body)

    def has(*words: str) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(text, F.lit(word))
        return test

    quota = has("insufficient_quota", "quota exceeded")
    throttled = has("rate limit", "too many requests", "requests per min", "rpm") | (text == "")
    told = has("rate limit reached", "too many requests")
    limited = ~quota & F.when(status == 429, throttled).otherwise(told)
    return (
        F.when(limited, "rate_limited")
        .when((status == 429) | (status >= 500), "retryable")
        .when(status != 200, "fatal")
        .otherwise("ok")
    )


def classify_calls(calls: DataFrame) -> DataFrame:
    return calls.withColumn("class", call_class(F.col("status_code"), F.col("body")))


def retry_backlog(calls: DataFrame, max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Requests still to be tried, and from when.

    Rate-limited tries do not count as attempts but hold the request until the
    next full minute; a counted failure holds it for 2^attempts seconds.
    """
    classed = classify_calls(calls)
    kind = F.col("class")
    per = classed.groupBy("request_id").agg(
        F.count_if(kind.isin("ok", "fatal")).alias("finished"),
        F.count_if(kind == "retryable").cast("int").alias("attempts"),
        F.max(F.when(kind == "rate_limited", F.col("ts"))).alias("limited_at"),
        F.max(F.when(kind == "retryable", F.col("ts"))).alias("failed_at"),
    )
    minute = F.date_trunc("minute", "limited_at") + F.expr("interval 1 minute")
    backoff = F.expr("failed_at + make_dt_interval(0, 0, 0, shiftleft(1, attempts))")
    return per.filter((F.col("finished") == 0) & (F.col("attempts") < max_attempts)).select(
        "request_id",
        "attempts",
        F.greatest(minute, backoff).cast("timestamp_ntz").alias("eligible_at"),
    )


def scan_results(files: DataFrame, contexts: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per file: the first failing stage's error, or both stages' outcome.

    ``contexts`` and ``scans`` are response rows keyed by (run_id, file_id).
    """
    keys = ["run_id", "file_id"]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        kept = ("content", "prompt_tokens", "completion_tokens", "total_tokens", "elapsed_s", "error")
        return df.select(*keys, F.lit(True).alias(f"{prefix}_seen"), *[F.col(c).alias(f"{prefix}_{c}") for c in kept])

    joined = files.join(side(contexts, "ctx"), keys, "left").join(side(scans, "scan"), keys, "left")
    missing = F.lit("no response")
    ctx_error = F.when(F.col("ctx_seen").isNull(), missing).otherwise(F.col("ctx_error"))
    scan_error = F.when(F.col("scan_seen").isNull(), missing).otherwise(F.col("scan_error"))
    staged = joined.withColumn("_ctx_error", ctx_error).withColumn(
        "error", F.coalesce("_ctx_error", scan_error)
    )
    ctx_ok = F.col("_ctx_error").isNull()
    ok = F.col("error").isNull()

    def tokens(name: str, source: str, when: Column) -> Column:
        return F.when(when, F.coalesce(F.col(source), F.lit(0))).otherwise(0).alias(name)

    def seconds(name: str, value: Column, when: Column) -> Column:
        return F.when(when, half_up(value, 10)).otherwise(F.lit(0.0)).alias(name)

    return staged.select(
        *keys,
        "display_name",
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.when(ctx_ok, F.col("ctx_content")).otherwise("").alias("context"),
        F.when(ok, F.col("scan_content")).otherwise("").alias("report"),
        tokens("context_tokens", "ctx_total_tokens", ctx_ok),
        tokens("prompt_tokens", "scan_prompt_tokens", ok),
        tokens("completion_tokens", "scan_completion_tokens", ok),
        tokens("total_tokens", "scan_total_tokens", ok),
        seconds("context_elapsed", F.col("ctx_elapsed_s"), ctx_ok),
        seconds("scan_elapsed", F.col("scan_elapsed_s"), ok),
        seconds("total_elapsed", F.col("ctx_elapsed_s") + F.col("scan_elapsed_s"), ok),
    )
