"""From a source tree to the files of a finished review."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.severity import one_of, unit_interval
from ..functions.text import digest_id
from ..operators import corpus
from ..operators import reports as rep
from ..operators import triage as tri
from ..operators.ignore_rules import ignored_by_rules
from ..session import durable, kept
from ..sources import outputs, tree
from .runs import FILE, Model, review_run

SCOPES = ("all", "changed")
FAIL_MODES = ("never", "validated", "raw")


def discover(
    spark: SparkSession,
    run_id: str,
    roots: list[str],
    repo: str,
    *,
    scope: str = "all",
    changed: DataFrame | None = None,
    rules: DataFrame | None = None,
    extensions: Iterable[str] = fixed.EXTENSIONS,
    max_bytes: int = fixed.MAX_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(files, classified) of a run; ``classified`` has each file's reason, null if it is kept.

    Scope ``all`` walks the roots and does not enter excluded directories; ``changed`` takes
    the paths of ``changed`` (run_id, path) at or below a root, wherever they lie.  ``rules``
    are the ignore rules of the tree, with folders relative to ``repo``.
    """
    one_of(scope, SCOPES, "scope")
    found = tree.read_tree(spark, {run_id: roots}, None if scope == "all" else ())
    if scope == "changed":
        if changed is None:
            raise ValueError("changed scope needs the changed paths")
        tops = spark.createDataFrame([(run_id, r) for r in roots], "run_id string, root string")
        found = found.join(corpus.changed_scope(changed, tops, repo), ["run_id", "path"], "left_semi")
    found = durable(found)
    ignored = None
    if rules is not None:
        inside = found.select("run_id", "path", corpus.display_name(repo).alias("_inside"))
        left_out = ignored_by_rules(inside.select("run_id", F.col("_inside").alias("path")), rules)
        ignored = inside.join(left_out.withColumnRenamed("path", "_inside"), ["run_id", "_inside"], "left_semi").select("run_id", "path")
    classified = durable(corpus.with_skip_reason(found, ignored, extensions, max_bytes))
    kept = classified.filter(F.col("reason").isNull()).select("run_id", "path", "lines", "chars")
    files = found.select("run_id", "path", F.col("content").cast("string").alias("content")).join(kept, ["run_id", "path"])
    return (
        files.withColumn("file_id", digest_id(F.col("run_id"), F.col("path"))).withColumn("display_name", corpus.display_name(repo)),
        classified,
    )


def _failures(findings: DataFrame, triage: DataFrame, mode: str, fail_on: str, confidence: float) -> DataFrame:
    if mode == "validated":
        return rep.gate_validated(triage, fail_on, confidence)
    if mode == "raw":
        named = findings.withColumn("finding_id", digest_id(F.col("run_id"), F.col("file_id"), F.col("pos")))
        return rep.gate_raw(named, fail_on).withColumn("finding_id", digest_id(F.col("run_id"), F.col("file"), F.col("title")))
    return triage.limit(0)


def finish_run(
    out: str,
    runs: DataFrame,
    results: DataFrame,
    findings: DataFrame,
    triage: DataFrame,
    rounds: DataFrame,
    totals: DataFrame,
    *,
    stamp: str,
    target: str,
    model: str,
    wall_s: float = 0.0,
    title: str = "Scan results",
    comment_title: str = "Review",
    tool: str = "auditloom",
    formats: Iterable[str] = (),
    min_confidence: float = 0.0,
    fail_mode: str = "never",
    fail_on: str = "high",
    fail_confidence: float = fixed.FAIL_CONFIDENCE,
) -> DataFrame:
    """Gate a reviewed run and write its files; returns ``reports.gate_status``.

    ``results`` has the severity counts and texts of each file, ``triage`` the finding's
    description and body, ``totals`` is ``corpus.corpus_totals``.
    """
    one_of(fail_mode, FAIL_MODES, "fail mode")
    unit_interval(min_confidence, "min confidence")
    failing = durable(_failures(findings, triage, fail_mode, fail_on, fail_confidence))
    gate = durable(rep.gate_status(runs, results, failing, fail_mode))
    summary = durable(rep.run_summary(runs, results, totals).withColumn("wall_s", F.lit(float(wall_s))))
    ranked = durable(rep.file_ranking(results))
    slugs = durable(outputs.unique_slugs(results))
    ordered = durable(tri.triage_order(triage))
    told = rep.nested_triage(ordered, rounds)
    details = (
        rep.triage_details(ordered, rounds)
        .unionByName(rep.survivor_details(rep.survivors(triage, min_confidence), stamp))
        .unionByName(rep.file_details(results, slugs))
    )
    page = rep.markdown_table(summary, ranked, failing, title, model, target, stamp)
    comment = rep.comment_page(
        summary, ranked, rep.comment_items(findings, triage, min_confidence),
        rep.report_section(runs, findings, triage, results, min_confidence), failing, comment_title, model,
    )
    parts = {
        "json": [
            outputs.summary_json(summary, gate, stamp, target, model, min_confidence),
            outputs.result_json(rep.nested_results(results, findings), slugs, stamp, model),
            outputs.triage_json(told),
        ],
        "markdown": [
            outputs.pages(durable(page), ["section", "position"], "line", "summary", "\n", "\n"),
            outputs.pages(durable(comment), ["section", "position"], "text", "pr-comment", "\n"),
            *outputs.documents(kept(details)),
        ],
        "sarif": [outputs.sarif_files(rep.sarif_log(rep.sarif_results(findings, triage), tool))],
    }
    outputs.write_outputs(out, parts, formats)
    return gate


def review_tree(
    spark: SparkSession,
    out: str,
    run_id: str,
    roots: list[str],
    repo: str,
    model_fn: Model,
    *,
    scan: dict,
    triage: dict,
    stamp: str,
    found: dict | None = None,
    threshold: str = "medium",
    mode: str = "enabled",
    concurrency: int | None = None,
    answers: str | None = None,
    retry: dict | None = None,
    **finish,
) -> DataFrame:
    """A whole review: find files, scan, triage, gate, write; returns the gate's status.

    ``found`` holds the other arguments of ``discover``, ``finish`` those of ``finish_run``.
    The search covers every file that is neither ignored nor binary, of any extension.
    """
    began = time.monotonic()
    files, classified = discover(spark, run_id, roots, repo, **(found or {}))
    files = durable(files)
    searched = classified.filter(~F.coalesce(F.col("reason").isin("gitignore", "binary", "symlink", "unreadable"), F.lit(False)))
    texts = tree.read_tree(spark, {run_id: roots}).filter(F.col("kind") == "file")
    lines = corpus.corpus_lines(texts.join(searched.select("run_id", "path"), ["run_id", "path"], "left_semi"))
    results, findings, decided, rounds = review_run(
        files, lines, model_fn, scan=scan, triage=triage, threshold=threshold, mode=mode,
        concurrency=concurrency, answers=answers, retry=retry,
    )
    runs = spark.createDataFrame([(run_id,)], "run_id string")
    return finish_run(
        out, runs, *_joined(files, results, findings, decided), rounds, corpus.corpus_totals(runs, classified),
        stamp=stamp, target=", ".join(roots), model=scan.get("model", ""), wall_s=time.monotonic() - began, **finish,
    )


def _joined(files: DataFrame, results: DataFrame, findings: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results with counts and sizes, findings, and decisions with their findings' texts."""
    zero = F.lit(0).cast("long")
    counts = findings.groupBy(*FILE).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES])
    sized = files.select(*FILE, "path", "lines", "chars")
    full = results.join(sized, FILE).join(counts, FILE, "left").select(
        *results.columns, "path", "lines", "chars", *[F.coalesce(s, zero).alias(s) for s in fixed.SEVERITIES]
    )
    named = findings.select(
        digest_id(F.col("run_id"), F.col("file_id"), F.col("pos")).alias("finding_id"), "run_id", "description", "body"
    )
    return durable(full), findings, durable(decided.join(named, ["run_id", "finding_id"]))
