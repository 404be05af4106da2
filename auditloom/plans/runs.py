"""Whole runs: scan a corpus, then triage what it found, with a pluggable model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import digest_id
from ..operators import completions as comp
from ..operators import findings as find
from ..operators import triage as tri
from ..operators.attempts import settle
from ..operators.search_index import SearchIndex, indexed
from ..session import durable, scratch_dir

Model = Callable[[pd.DataFrame], pd.DataFrame]
FILE = ["run_id", "file_id"]
ROUND = ["run_id", "finding_id", "round_no"]


def _keyed(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    return requests.select(*keys, "request_id").join(responses, "request_id").drop("request_id")


def _answers(
    requests: DataFrame, model_fn: Model, concurrency: int | None, folder: str | None, retry: dict | None
) -> DataFrame:
    """Response rows of the requests, stored batch by batch before they are used.

    With a shared ``folder`` tries outlive the session: only requests without an answer
    there are asked, and those that failed until they have failed often enough.
    """
    spark = requests.sparkSession
    place = folder or f"{scratch_dir(spark)}/tries-{uuid.uuid4().hex}"

    def ask(due: DataFrame) -> DataFrame:
        return comp.run_completions(due, model_fn, schema=comp.TRY)

    return durable(settle(requests, ask, place, width=concurrency, **(retry or {})))


def scan_run(
    files: DataFrame,
    lines: DataFrame | SearchIndex,
    model_fn: Model,
    *,
    model: str,
    context_system: str,
    scan_system: str,
    context_heading: str,
    example: tuple[str, str],
    user_template: str,
    concurrency: int | None = None,
    answers: str | None = None,
    retry: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, findings) of files (run_id, file_id, display_name, content).

    Responses of each stage are stored before they are used, in the folder ``answers``
    if given: a run started again asks only what has no answer there.
    """
    asked = comp.context_requests(files, context_system, model)
    contexts = _keyed(asked, _answers(asked, model_fn, concurrency, answers, retry), FILE)
    evidence = indexed(lines).evidence(contexts.filter("error IS NULL"), FILE, "content")
    full = F.concat(
        "content",
        F.when(
            F.col("evidence").isNotNull(),
            F.concat(F.lit(fixed.CONTEXT_EVIDENCE_HEADING), "evidence"),
        ).otherwise(""),
    )
    contexts = durable(contexts.join(evidence, FILE, "left").withColumn("content", full).drop("evidence"))
    told = contexts.filter("error IS NULL").withColumnRenamed("content", "context")
    scans = comp.scan_requests(
        files, told, scan_system, context_heading, example, user_template, model
    )
    scanned = _keyed(scans, _answers(scans, model_fn, concurrency, answers, retry), FILE)
    results = comp.scan_results(files, contexts, scanned)
    findings = find.parse_findings(results.filter("status = 'ok'"), [*FILE, "display_name"])
    return results, findings


def triage_run(
    findings: DataFrame,
    lines: DataFrame | SearchIndex,
    model_fn: Model,
    *,
    project: str,
    template: str,
    arbiter_template: str,
    model: str = "",
    system: str = "",
    arbiter_system: str = "",
    earlier: str = tri.EARLIER,
    rounds: int = fixed.ROUNDS,
    concurrency: int | None = None,
    answers: str | None = None,
    retry: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, rounds) of findings (see ``round_prompts`` for their columns).

    ``system`` and ``arbiter_system`` are the instructions sent with each prompt, ``earlier``
    stands before the earlier reviews.

    Rounds follow each other because each sees the earlier reviews; one round is
    one distributed step over all findings.
    """
    count = rounds if rounds > 0 else fixed.ROUNDS

    def ask(prompts: DataFrame, round_no: int, stage: str, instructions: str) -> DataFrame:
        requests = comp.triage_requests(
            prompts.withColumn("round_no", F.lit(round_no)), ROUND, stage, instructions, model
        )
        found = _answers(requests, model_fn, concurrency, answers, retry)
        return tri.parse_verdicts(_keyed(requests, found, ROUND), ROUND)

    index = indexed(lines)  # the lines are read here, rounds read the index
    done: DataFrame | None = None
    for number in range(1, count + 1):
        blank = findings.select(
            "run_id",
            "finding_id",
            F.lit(number).alias("round_no"),
            F.lit("").alias("reasoning"),
            F.lit(None).cast("string").alias("evidence"),
        )
        seen = blank if done is None else done.select(blank.columns).unionByName(blank)
        prompts = tri.round_prompts(findings, seen, template, project, earlier)
        parsed = durable(ask(prompts.filter(F.col("round_no") == number), number, "round", system))
        evidence = index.evidence(parsed, ROUND, "reasoning")
        told = durable(tri.round_evidence(parsed, evidence))
        done = told if done is None else done.unionByName(told)
    arbiter = done.limit(0)
    if count > 1:
        prompts = tri.arbiter_requests(findings, done, arbiter_template, project)
        arbiter = ask(prompts, count + 1, "arbiter", arbiter_system)
    return tri.final_verdict(findings, done, arbiter), done


def triage_input(
    files: DataFrame,
    results: DataFrame,
    findings: DataFrame,
    threshold: str = "medium",
    mode: str = "enabled",
) -> DataFrame:
    """Candidates with an id of their own, their file's code and its context."""
    named = findings.withColumn(
        "finding_id", digest_id(F.col("run_id"), F.col("file_id"), F.col("pos"))
    )
    code = files.select(*FILE, F.col("content").alias("code"))
    return (
        tri.triage_candidates(named, results, threshold, mode)
        .withColumnRenamed("display_name", "file")
        .join(code, FILE)
        .join(results.select(*FILE, "context"), FILE)
    )


def review_run(
    files: DataFrame,
    lines: DataFrame | SearchIndex,
    model_fn: Model,
    *,
    scan: dict,
    triage: dict,
    threshold: str = "medium",
    mode: str = "enabled",
    concurrency: int | None = None,
    answers: str | None = None,
    retry: dict | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(results, findings, decisions, rounds): scan files, then triage what was found.

    ``scan`` and ``triage`` hold the other arguments of ``scan_run`` and ``triage_run``,
    ``retry`` those of ``attempts.settle``.
    """
    shared = {"concurrency": concurrency, "answers": answers, "retry": retry}
    lines = indexed(lines)
    results, findings = (durable(x) for x in scan_run(files, lines, model_fn, **scan, **shared))
    chosen = durable(triage_input(files, results, findings, threshold, mode))
    decided, rounds = triage_run(chosen, lines, model_fn, **triage, **shared)
    return results, findings, decided, rounds
