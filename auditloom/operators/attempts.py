"""Paid calls: a queue that commits answers batch by batch, and retries over a ledger.

The ledger is a table of tries.  A round asks what is due (``completions.call_class``
judges the tries so far), in small batches; each batch's tries are stored before the
next is asked.  What is lost with an executor or the driver is one batch at most: a new
run reads the ledger and asks only what has no answer there.
"""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..session import durable
from . import completions as comp

LEDGER = f"{comp.TRY}, attempt int, tried_at timestamp_ntz"
#: Requests that one task asks before its answers are stored.
BATCH = 64

Ask = Callable[[DataFrame], DataFrame]


def now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)


class Ledger:
    """Tries of requests in a shared folder; runs at the same time may share it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # an empty batch, so that there is a table before the first try
        spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{folder}/tries/batch=none")

    def tries(self) -> DataFrame:
        schema = T.StructType.fromDDL(LEDGER).add("batch", "string")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/tries").drop("batch")

    def ask(self, due: DataFrame, ask: Ask, clock: Callable[[], datetime.datetime], batch: int, width: int) -> None:
        """Ask requests (with ``attempt``) in batches of ``width`` tasks of ``batch`` rows."""
        name = uuid.uuid4().hex
        queue = f"{self.folder}/queue/{name}"
        due.hint("rebalance").write.option("maxRecordsPerFile", batch).parquet(queue)

        def step(rows: DataFrame, number: int) -> None:
            told = ask(rows).withColumn("tried_at", F.lit(clock()).cast("timestamp_ntz"))
            columns = [f.split()[0] for f in LEDGER.split(", ")]
            # a repeated batch overwrites its own tries only
            numbered(told, rows).select(*columns).write.mode("overwrite").parquet(f"{self.folder}/tries/batch={name}-{number}")

        stream = (
            self.spark.readStream.schema(due.schema)
            .option("maxFilesPerTrigger", width)
            .parquet(queue)
            .writeStream.option("checkpointLocation", f"{self.folder}/state/{name}")
            .trigger(availableNow=True)
            .foreachBatch(step)
            .start()
        )
        stream.awaitTermination()


def numbered(told: DataFrame, rows: DataFrame) -> DataFrame:
    """Tries with the number of the try.

    Ids are few bytes on disk and many in memory, so by its size on disk Spark would send a
    batch of a million through the driver to every task; the hint keeps it in the shuffle.
    """
    return told.join(rows.select("request_id", "attempt").hint("merge"), "request_id")


def judged(tries: DataFrame) -> DataFrame:
    """Tries with their class; without a status, an error stands for a server's failure."""
    status = F.coalesce("status_code", F.when(F.col("error").isNull(), 200).otherwise(500))
    return tries.withColumn("status_code", status).withColumn(
        "class", comp.call_class(status, F.coalesce("body", "error", F.lit("")))
    )


def backlog(requests: DataFrame, tries: DataFrame, max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Requests still to be asked, the number of the next try, and from when.

    Like ``completions.retry_backlog``, with the requests never asked, which are due at once.
    """
    classed = judged(tries).select("request_id", "class", "tried_at")
    calls = classed.groupBy("request_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.count_if(F.col("class").isin("ok", "fatal")).alias("finished"),
        F.count_if(F.col("class") == "retryable").cast("int").alias("counted"),
        F.max(F.when(F.col("class") == "rate_limited", F.col("tried_at"))).alias("limited_at"),
        F.max(F.when(F.col("class") == "retryable", F.col("tried_at"))).alias("failed_at"),
    )
    minute = F.date_trunc("minute", "limited_at") + F.expr("interval 1 minute")
    pause = F.expr("failed_at + make_dt_interval(0, 0, 0, shiftleft(1, counted))")
    open_ = F.col("n").isNull() | ((F.col("finished") == 0) & (F.col("counted") < max_attempts))
    return (
        requests.join(calls.hint("merge"), "request_id", "left")
        .filter(open_)
        .select(
            *requests.columns,
            (F.coalesce("n", F.lit(0)) + 1).alias("attempt"),
            F.greatest(minute.cast("timestamp_ntz"), pause.cast("timestamp_ntz")).alias("eligible_at"),
        )
    )


def settle(
    requests: DataFrame,
    ask: Ask,
    folder: str,
    *,
    max_attempts: int = fixed.MAX_ATTEMPTS,
    batch: int = BATCH,
    width: int | None = None,
    clock: Callable[[], datetime.datetime] = now,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Ask until every request has an answer, a fatal error or enough counted failures.

    ``ask`` takes requests and returns their tries (columns ``completions.TRY``).  The result
    has one response row a request: the first answer, else the last error.
    """
    spark = requests.sparkSession
    ledger = Ledger(spark, folder)
    tasks = width or spark.sparkContext.defaultParallelism
    requests = durable(requests)
    while True:
        left = durable(backlog(requests, ledger.tries(), max_attempts))
        first = left.agg(F.min(F.coalesce("eligible_at", F.lit(datetime.datetime(1970, 1, 1)).cast("timestamp_ntz")))).first()[0]
        if first is None:
            break
        at = clock()
        if first > at:
            wait((first - at).total_seconds())
            continue
        due = left.filter(F.col("eligible_at").isNull() | (F.col("eligible_at") <= F.lit(at).cast("timestamp_ntz")))
        ledger.ask(due.drop("eligible_at"), ask, clock, batch, tasks)
    return answers(requests, ledger.tries())


def answers(requests: DataFrame, tries: DataFrame) -> DataFrame:
    """One response row a request: the first answer, else the last error."""
    row = F.struct(*[F.col(f.split()[0]) for f in comp.RESPONSE.split(", ")])
    classed = judged(tries).withColumn("_row", row)
    got = F.col("class") == "ok"
    per = classed.groupBy("request_id").agg(
        F.min_by("_row", F.when(got, F.struct("tried_at", "attempt"))).alias("answer"),
        F.max_by("_row", F.when(~got, F.struct("tried_at", "attempt"))).alias("last"),
        F.max_by(F.coalesce("error", "body"), F.when(~got, F.struct("tried_at", "attempt"))).alias("why"),
    )
    asked = per.join(requests.select("request_id").hint("merge"), "request_id", "left_semi")
    chosen = asked.select(F.coalesce("answer", "last").alias("r"), F.col("answer").isNotNull().alias("ok"), "why")
    fields = [f.split()[0] for f in comp.RESPONSE.split(", ")]
    return chosen.select(
        *[F.col(f"r.{f}").alias(f) for f in fields if f != "error"],
        F.when(~F.col("ok"), F.coalesce("r.error", "why", F.lit("no answer"))).alias("error"),
    )
