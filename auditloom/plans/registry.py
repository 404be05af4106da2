"""The queries: operators applied to the views of ``views.py``."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.severity import normalize_severity
from ..functions.text import truncate_text
from ..operators import attempts
from ..operators import completions as comp
from ..operators import corpus
from ..operators import evidence as ev
from ..operators import findings as find
from ..operators import reports as rep
from ..operators import triage as tri
from ..operators.ignore_rules import ignored_by_rules
from ..operators.ranking import running_sums
from ..session import discard, durable, kept, scratch_dir
from ..sources import outputs, sinks, tree
from ..streaming import live
from . import trees
from .views import view

MAX_BYTES = 2000
MODEL = "reviewer-1"
PROJECT = "demo"
STAMP = "2024-01-01_000000"
SYSTEM = "Brief the reviewer."
SCAN_SYSTEM = "List the defects as JSON."
CONTEXT_HEADING = "\n\nContext:\n"
EXAMPLE = ("Review: int f();", "[]")
USER_TEMPLATE = "Review %s:\n```\n%s\n```"
EARLIER_REVIEWS = "\n\nWhat others found so far:\n\n"
ROUND_TEMPLATE = "Project %s\n%s\nFile %s\n```\n%s\n```"
ARBITER_TEMPLATE = (
    "Project %s, title %s\n%s\nEvidence:\n%s\nVotes %s (%d for, %d against)\nFile %s\n```\n%s\n```"
)

FILE = ["run_id", "file_id"]
FINDING = ["run_id", "finding_id"]
ROUND = ["run_id", "finding_id", "round_no"]
NAMED = [*FILE, "display_name"]


class Inputs:
    """Lazily built inputs of one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def once(self, name: str) -> DataFrame:
        """A derived input that the query uses more than once: computed once and stored."""
        if name not in self._kept:
            self._kept[name] = durable(getattr(self, name)())
        return self._kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    # -- derived inputs

    def findings(self) -> DataFrame:
        return find.parse_findings(self.reports.filter("status = 'ok'"), NAMED)

    def results(self) -> DataFrame:
        """One row per file with its counts; files with errors count nothing."""
        return self._with_lines(find.severity_counts(self._shown(), [*NAMED, "status", "error"]))

    def once_parsed(self) -> None:
        """Results and findings, for a query that uses both, of one parse of the reports."""
        if "findings" not in self._kept:
            counts, findings = find.parse_and_count(self._shown(), NAMED, ["status", "error"])
            self._kept["findings"] = findings  # an empty report has none
            self._kept["results"] = durable(self._with_lines(counts))

    def _shown(self) -> DataFrame:
        """The reports, those of files with errors without text."""
        return self.reports.withColumn("report", F.when(F.col("status") == "ok", F.col("report")).otherwise(""))

    def _with_lines(self, counts: DataFrame) -> DataFrame:
        files = self.source_files.select(
            *FILE,
            (F.octet_length("content") - F.octet_length(F.replace("content", F.lit("\n"), F.lit(""))))
            .cast("int")
            .alias("lines"),
        )
        return counts.join(files, FILE)

    def file_texts(self) -> DataFrame:
        """Report and context of every file."""
        context = self.contexts.select(*FILE, F.col("content").alias("context"))
        return self.reports.join(context, FILE)

    def arbiter_split(self) -> tuple[DataFrame, DataFrame]:
        """The highest round of a finding plays the arbiter."""
        keyed = self.rounds.join(self.last_rounds, ["run_id", "finding_id"])
        return (
            keyed.filter("round_no < last_round").drop("last_round"),
            keyed.filter("round_no = last_round").drop("last_round"),
        )

    def triage(self) -> DataFrame:
        rounds, arbiter = self.arbiter_split()
        findings = self.triage_findings.select("run_id", "finding_id", "file", "title", "severity")
        return tri.final_verdict(findings, rounds, arbiter)

    def triage_full(self) -> DataFrame:
        extra = self.triage_findings.select("run_id", "finding_id", "description", "body")
        return self.triage().join(extra, ["run_id", "finding_id"])

    def corpus_lines(self) -> DataFrame:
        """Searchable lines: every file that is neither ignored nor binary."""
        kept, _ = corpus.ignore_antijoin(corpus.binary_gate(self.source_files), self.ignored_paths)
        return corpus.corpus_lines(kept)

    def patterns(self) -> DataFrame:
        return ev.clean_patterns(self.rounds, ROUND)

    def evidence(self) -> DataFrame:
        return ev.gather_evidence(self.rounds, self.corpus_lines(), ROUND, "reasoning")

    def with_evidence(self, make: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
        """``make`` of the rounds with their evidence, for some findings at a time; stored.

        It also gets a function that leaves the rows of these findings in another table.
        """
        return ev.gather_evidence(
            self.rounds, self.corpus_lines(), ROUND, "reasoning", FINDING,
            lambda rounds, evidence, mine: make(tri.round_evidence(rounds, evidence), mine),
        )

    def rounds_with_evidence(self) -> DataFrame:
        return self.with_evidence(lambda rounds, _: rounds)

    def round_prompts(self) -> DataFrame:
        findings = kept(self.coded_findings())
        prompts = self.with_evidence(
            lambda rounds, mine: tri.round_prompts(mine(findings), rounds, ROUND_TEMPLATE, PROJECT, EARLIER_REVIEWS)
        )
        discard(findings)
        return prompts

    def triage_details(self, triage: DataFrame) -> DataFrame:
        ordered = kept(tri.triage_order(triage))
        details = self.with_evidence(lambda rounds, mine: rep.triage_details(mine(ordered), rounds))
        discard(ordered)
        return details

    def coded_findings(self) -> DataFrame:
        """Triage findings with their code and context."""
        code = self.source_files.select(
            "run_id", F.col("file_id").alias("finding_id"), F.col("content").alias("code")
        )
        context = self.contexts.select(
            "run_id", F.col("file_id").alias("finding_id"), F.col("content").alias("context")
        )
        keys = ["run_id", "finding_id"]
        return self.triage_findings.join(code, keys, "left").join(context, keys, "left")

    def classified(self) -> DataFrame:
        pruned = corpus.prune_dirs(self.source_files)
        return corpus.with_skip_reason(pruned, self.ignored_paths, max_bytes=MAX_BYTES)


def _listing(df: DataFrame) -> DataFrame:
    """File rows with their content's size instead of the content."""
    return df.select("run_id", "path", F.octet_length("content").alias("chars"))


# ---- A -------------------------------------------------------------------------


def _scan_tree(i: Inputs) -> DataFrame:
    """The tree written and read whole through the tree source: every directory, name and size."""
    _, roots = trees.write_tree(i.source_files)
    found = tree.read_tree(i.spark, roots, excluded=())
    return found.select(
        "run_id", trees.inside(F.col("path")).alias("path"), "kind", "length", F.sha2("content", 256).alias("digest")
    )


def _stream_tree(i: Inputs) -> DataFrame:
    """The tree as a stream, drained; paths relative to their run's folder."""
    _, roots = trees.write_tree(i.source_files)
    landed = live.changed_files(tree.stream_tree(i.spark, roots)).withColumn("path", trees.inside(F.col("path")))
    rows = live.drain_append(live.arriving_files(landed, MAX_BYTES, base="repo"))
    return rows.select("run_id", "path", "display_name", "lines", "chars", "reason")


def _ignore(i: Inputs) -> DataFrame:
    slim = _listing(i.source_files)
    kept, dropped = corpus.ignore_antijoin(slim, i.ignored_paths)
    return kept.select("run_id", "path", F.lit("kept").alias("reason")).unionByName(dropped)


def _changed(i: Inputs) -> DataFrame:
    return corpus.changed_scope(i.changed_paths, i.changed_roots, "/work")


def _ledger(i: Inputs) -> DataFrame:
    pruned = corpus.prune_dirs(i.source_files)
    return corpus.skip_ledger(pruned, i.ignored_paths, max_bytes=MAX_BYTES)


# ---- B -------------------------------------------------------------------------


def _requests(i: Inputs) -> DataFrame:
    files = i.source_files.withColumn("display_name", F.col("path"))
    return comp.context_requests(corpus.binary_gate(files), SYSTEM, MODEL)


def _scan_requests(i: Inputs) -> DataFrame:
    files = corpus.binary_gate(i.source_files).withColumn("display_name", F.col("path"))
    contexts = i.contexts.filter("error IS NULL").withColumnRenamed("content", "context")
    return comp.scan_requests(
        files, contexts, SCAN_SYSTEM, CONTEXT_HEADING, EXAMPLE, USER_TEMPLATE, MODEL
    )


def _completions(i: Inputs) -> DataFrame:
    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        sent = batch["payload"].str.len()
        return pd.DataFrame(
            {
                "request_id": batch["request_id"],
                "content": "read " + sent.astype(str),
                "prompt_tokens": sent,
                "completion_tokens": 2,
                "total_tokens": sent + 2,
                "elapsed_s": 0.5,
                "error": None,
            }
        )

    return comp.run_completions(_requests(i), answer, batched=True)


def _replay(i: Inputs) -> DataFrame:
    recorded = i.scans.select(
        F.md5(F.concat_ws("\x1f", F.lit("context"), "run_id", F.col("file_id").cast("string"))).alias(
            "request_id"
        ),
        "content",
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        "elapsed_s",
        "error",
    ).filter("error IS NULL")
    return comp.replay_completions(_requests(i), recorded)


def _scan_results(i: Inputs) -> DataFrame:
    files = i.source_files.select(*FILE, F.col("path").alias("display_name"))
    return comp.scan_results(files, i.contexts, i.scans)


# ---- C -------------------------------------------------------------------------


def _normalize(i: Inputs) -> DataFrame:
    """Every severity word the reports and the triage findings use, and role names."""
    words = i.triage_findings.select(F.upper("severity").alias("raw")).unionByName(
        i.reports.select(F.concat(F.lit(" \t"), F.initcap("status"), F.lit("\n")).alias("raw"))
    )
    mixed = words.unionByName(i.triage_findings.select(F.concat("severity", F.lit(" \n")).alias("raw")))
    return mixed.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(
        "raw", normalize_severity(F.col("raw")).alias("severity"), "n"
    )


# ---- F -------------------------------------------------------------------------


def _gate_status(i: Inputs) -> DataFrame:
    return rep.gate_status(i.runs, i.reports, rep.gate_validated(i.triage()), "validated")


def _summary(i: Inputs, results: DataFrame) -> DataFrame:
    return rep.run_summary(i.runs, results, corpus.corpus_totals(i.runs, i.classified()))


def _markdown(i: Inputs) -> DataFrame:
    results = i.once("results")
    failing = durable(rep.gate_validated(i.once("triage_full")))
    return rep.markdown_table(
        _summary(i, results).withColumn("wall_s", F.col("files_scanned") / F.lit(2.0)),
        rep.file_ranking(results), failing, "Scan results", MODEL, "repo", STAMP,
    )


def _comment(i: Inputs) -> DataFrame:
    i.once_parsed()
    results, triage, findings = i.once("results"), i.once("triage_full"), i.once("findings")
    return rep.comment_page(
        _summary(i, results),
        rep.file_ranking(results),
        rep.comment_items(findings, triage, 0.75),
        rep.report_section(i.runs, findings, triage, i.reports, 0.75),
        rep.gate_validated(triage),
        "Review",
        MODEL,
    )


def _details(i: Inputs) -> DataFrame:
    triage = i.once("triage_full")
    return (
        i.triage_details(triage)
        .unionByName(rep.survivor_details(rep.survivors(triage), STAMP))
        .unionByName(rep.file_details(i.file_texts()))
    )


def _write_run(i: Inputs) -> DataFrame:
    """Write every format, then read back what was written: format and rows per run."""
    out = f"{scratch_dir(i.spark)}/write-run-{uuid.uuid4().hex}"
    i.once_parsed()
    triage = i.once("triage_full")
    findings = i.once("findings")
    sarif = rep.sarif_log(rep.sarif_results(findings, triage), "auditloom")
    documents = rep.file_details(i.file_texts())
    results = i.once("results")
    sinks.write_run(
        out,
        _summary(i, results),
        rep.nested_results(results, findings),
        rep.nested_triage(triage, i.rounds),
        _markdown(i),
        documents,
        sarif,
    )
    parts = []
    for name, kind in (
        ("summary", "json"), ("results", "json"), ("triage", "json"),
        ("pages", "parquet"), ("documents", "parquet"), ("sarif", "text"),
    ):
        back = i.spark.read.format(kind).load(f"{out}/{name}")
        parts.append(
            back.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.lit(name).alias("output"), F.col("run_id").cast("string"), "n_rows")
        )
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def _run_files(i: Inputs) -> DataFrame:
    """Write a run's files under their names, read them back through the tree source: name and digest."""
    out = f"{scratch_dir(i.spark)}/files-{uuid.uuid4().hex}"
    i.once_parsed()
    triage, results, findings = i.once("triage_full"), i.once("results"), i.once("findings")
    gate = rep.gate_status(i.runs, i.reports, rep.gate_validated(triage), "validated")
    summary = _summary(i, results).withColumn("wall_s", F.col("files_scanned") / F.lit(2.0))
    slugs = durable(outputs.unique_slugs(results))
    # the documents of decisions, which are stored, go first and leave their table to be removed
    told = i.triage_details(triage)
    outputs.write_outputs(out, {"markdown": [outputs.single_documents(told, "triage")]}, ["markdown"])
    discard(told)
    details = rep.survivor_details(rep.survivors(triage), STAMP).unionByName(rep.file_details(i.file_texts(), slugs))
    comment = durable(_comment(i))
    decided = tri.triage_order(rep.nested_triage(triage, i.rounds))
    outputs.write_outputs(out, {
        "json": [
            outputs.summary_json(summary, gate, STAMP, "repo", MODEL, 0.0),
            outputs.result_json(rep.nested_results(results, findings), slugs, STAMP, MODEL),
            outputs.triage_json(decided),
        ],
        "markdown": [
            outputs.pages(_markdown(i), ["section", "position"], "line", "summary", "\n", "\n"),
            outputs.pages(comment, ["section", "position"], "text", "pr-comment", "\n"),
            *outputs.documents(details, ["finding", "report", "context"]),
        ],
        "sarif": [outputs.sarif_files(rep.sarif_log(rep.sarif_results(findings, triage), "auditloom"))],
    })
    found = tree.read_tree(i.spark, {"all": [out]})
    inside = F.regexp_replace("path", r"^.*/files-[0-9a-f]{32}/", "")
    shown = found.select(inside.alias("path"), "content").filter(~F.col("path").rlike(r"/(results|triage)/|\.sarif$"))
    return shown.select("path", F.sha2("content", 256).alias("digest"))


def _attempts(i: Inputs) -> DataFrame:
    """The recorded calls, replayed: every request is asked until the rules let it rest."""
    calls = i.call_log.select(
        "request_id", "status_code", "body",
        F.row_number().over(Window.partitionBy("request_id").orderBy("ts", "call_id")).alias("attempt"),
    )
    recorded = durable(calls.withColumn("request_id", F.col("request_id").cast("string")))

    def ask(due: DataFrame) -> DataFrame:
        found = due.select("request_id", "attempt").join(recorded.hint("merge"), ["request_id", "attempt"], "left")
        said = found.withColumn("status_code", F.coalesce("status_code", F.lit(404)))
        return said.select(
            "request_id", F.lit("").alias("content"), *[F.lit(0).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
            F.lit(0.0).alias("elapsed_s"), F.when(F.col("status_code") != 200, F.lit("failed")).alias("error"),
            "status_code", F.coalesce("body", F.lit("no record")).alias("body"),
        )

    folder = f"{scratch_dir(i.spark)}/attempts-{uuid.uuid4().hex}"
    clock = [datetime.datetime(2024, 1, 1)]

    def wait(seconds: float) -> None:
        clock[0] += datetime.timedelta(seconds=seconds)

    # batches as wide as the table: nothing is paid for here
    attempts.settle(
        recorded.select("request_id").distinct(), ask, folder, batch=1 << 20, clock=lambda: clock[0], wait=wait
    )
    tries = attempts.judged(attempts.Ledger(i.spark, folder).tries())
    return tries.select(F.col("request_id").cast("long").alias("request_id"), "attempt", "status_code", "class")


# ---- G -------------------------------------------------------------------------


def _running(i: Inputs) -> DataFrame:
    """Totals after each completed file, in order of the time its event arrived."""
    done = i.events.select(F.col("event_id").alias("file_id"), F.col("ts").alias("done_at"))
    rows = i.results().join(done, "file_id", "left")
    ones = rows.withColumn("one", F.lit(1)).withColumn(
        "failed", (F.col("status") == "error").cast("int")
    )
    out = running_sums(ones, ["run_id"], [F.col("done_at"), F.col("file_id")], live.RUNNING)
    return out.select("run_id", "file_id", *live.RUNNING)


Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # corpus
    "corpus_scan": _scan_tree,
    "prune_dirs": lambda i: _listing(corpus.prune_dirs(i.source_files)),
    "ext_filter": lambda i: _listing(corpus.ext_filter(i.source_files)),
    "size_gate": lambda i: _listing(corpus.size_gate(i.source_files, MAX_BYTES)),
    "binary_gate": lambda i: _listing(corpus.binary_gate(i.source_files)),
    "ignore_antijoin": _ignore,
    "ignore_rules": lambda i: ignored_by_rules(i.source_files, i.ignore_rules),
    "changed_scope": _changed,
    "snapshot_diff": lambda i: corpus.snapshot_diff(i.source_files, i.base_files),
    "skip_ledger": _ledger,
    "skip_counts": lambda i: corpus.skip_counts(_ledger(i)),
    "source_profile": lambda i: corpus.source_profile(i.source_files, "repo"),
    "corpus_totals": lambda i: corpus.corpus_totals(i.runs, i.classified()),
    "corpus_lines": lambda i: corpus.corpus_lines(i.source_files),
    # completions
    "context_requests": lambda i: _requests(i).drop("messages", "reasoning_effort"),
    "scan_requests": lambda i: _scan_requests(i).drop("messages", "reasoning_effort"),
    "run_completions": _completions,
    "replay_completions": _replay,
    "decode_completions": lambda i: comp.decode_completions(i.wire).drop("body"),
    "classify_calls": lambda i: comp.classify_calls(i.call_log).select("call_id", "class"),
    "retry_backlog": lambda i: comp.retry_backlog(i.call_log),
    "attempts": _attempts,
    "scan_results": _scan_results,
    # findings
    "marker_findings": lambda i: find.marker_findings(i.reports, FILE),
    "json_findings": lambda i: find.json_findings(i.reports, FILE),
    "json_salvage": lambda i: find.json_salvage(i.reports, FILE),
    "heading_findings": lambda i: find.heading_findings(i.reports, FILE),
    "unstructured_findings": lambda i: find.unstructured_findings(i.reports, FILE),
    "parse_findings": lambda i: i.findings(),
    "normalize_severity": _normalize,
    "severity_threshold": lambda i: find.severity_threshold(i.findings(), "high").select(
        *FILE, "pos", "severity", "severity_rank"
    ),
    "severity_counts": lambda i: find.severity_counts(i.reports.filter("status = 'ok'"), NAMED),
    "top_severity": lambda i: find.with_top_severity(
        find.severity_counts(i.reports.filter("status = 'ok'"), FILE)
    ).select(*FILE, "top_severity"),
    # evidence
    "search_requests": lambda i: ev.search_requests(i.rounds, ROUND),
    "clean_patterns": lambda i: i.patterns(),
    "corpus_search": lambda i: ev.corpus_search(i.corpus_lines(), i.patterns()),
    "corpus_search_wide": lambda i: ev.corpus_search(
        i.corpus_lines(),
        i.source_files.select("run_id", F.substring("path", 6, 20).alias("pattern")).union(
            i.source_files.select("run_id", F.substring("content", 3, 24))
        ),
    ),
    "top_matches": lambda i: ev.first_matches(i.corpus_lines(), i.patterns()).select(
        "run_id", "pattern", "rn", "path", "line"
    ),
    "evidence_blocks": lambda i: i.evidence(),
    "condense_evidence": lambda i: i.with_evidence(
        lambda rounds, _: rounds.select(
            *ROUND,
            ev.condense_evidence(
                F.when(
                    F.col("grep_used"),
                    F.concat("reasoning", F.lit(fixed.EVIDENCE_HEADING), "evidence"),
                ).otherwise(F.col("reasoning"))
            ).alias("condensed"),
        )
    ),
    # triage
    "triage_candidates": lambda i: tri.triage_candidates(
        find.parse_findings(i.reports, NAMED), _scan_results(i)
    ).select(*FILE, "pos", "severity", "title"),
    "round_prompts": lambda i: i.round_prompts(),
    "triage_requests": lambda i: comp.triage_requests(
        i.round_prompts(), ROUND, "round", SYSTEM, MODEL
    ).drop("messages", "reasoning_effort"),
    "parse_verdicts": lambda i: tri.parse_verdicts(i.round_responses, ROUND),
    "round_evidence": lambda i: i.rounds_with_evidence().select(
        *ROUND, "verdict", "grep_used", "evidence"
    ),
    "confidence": lambda i: tri.confidence(i.rounds),
    "verdict_string": lambda i: tri.verdict_string(i.rounds),
    "arbiter_requests": lambda i: tri.arbiter_requests(
        i.coded_findings(), i.rounds_with_evidence(), ARBITER_TEMPLATE, PROJECT
    ),
    "final_verdict": lambda i: i.triage(),
    "triage_order": lambda i: tri.triage_order(i.triage()).select(
        "run_id", "finding_id", "position", "verdict", "confidence"
    ),
    "verdict_tally": lambda i: tri.verdict_tally(i.runs, i.triage()),
    # reports
    "file_ranking": lambda i: rep.file_ranking(i.results()).select(
        "run_id", "display_name", "position", *fixed.SEVERITIES
    ),
    "run_summary": lambda i: _summary(i, i.results()),
    "survivors": lambda i: rep.survivors(i.triage(), 0.5).select(
        "run_id", "finding_id", "position", "confidence"
    ),
    "raw_ranking": lambda i: rep.raw_ranking(i.findings()).select(
        *FILE, "pos", "position", "severity", "title"
    ),
    "gate_validated": lambda i: rep.gate_validated(i.triage()).select(
        "run_id", "finding_id", "file", "severity", "confidence"
    ),
    "gate_raw": lambda i: rep.gate_raw(i.findings()),
    "gate_status": _gate_status,
    "sarif_results": lambda i: rep.sarif_results(i.findings(), i.triage_full()),
    "sarif_log": lambda i: rep.sarif_log(rep.sarif_results(i.findings(), i.triage_full()), "auditloom"),
    "comment_topk": lambda i: rep.comment_topk(i.once("findings"), i.once("triage_full"), 0.75),
    "comment_page": _comment,
    "report_section": lambda i: rep.report_section(
        i.runs, i.once("findings"), i.once("triage"), i.reports, 0.75
    ),
    "markdown_table": _markdown,
    "truncate_text": lambda i: i.documents.select(
        "doc_id",
        truncate_text(F.col("text"), fixed.BODY_CHARS).alias("body"),
        truncate_text(F.col("text"), fixed.REASONING_CHARS).alias("reasoning"),
        truncate_text(F.col("text"), fixed.ERROR_CHARS).alias("error"),
    ),
    "safe_names": lambda i: rep.safe_names(
        i.source_files.select(*FILE, F.concat(F.lit("/"), "path", F.lit("  é!")).alias("display_name"))
    ).select(*FILE, "slug", "n_same", "collides"),
    "artifact_numbers": lambda i: rep.artifact_numbers(
        tri.triage_order(i.once("triage")), rep.survivors(i.once("triage"))
    ),
    "grand_totals": lambda i: rep.grand_totals(i.results()),
    "severity_rollup": lambda i: rep.severity_rollup(i.findings()),
    "detail_docs": _details,
    "write_run": _write_run,
    "run_files": _run_files,
    # live
    "running_totals": _running,
    "stream_severity": lambda i: live.stream_severity(i.spark, i.sf_dir),
    "stream_running_totals": lambda i: live.stream_running_totals(i.spark, i.sf_dir),
    "stream_corpus": _stream_tree,
}


def queries() -> dict[str, Query]:
    def bind(build: Callable[[Inputs], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(Inputs(spark, str(sf_dir).rstrip("/")))

    return {name: bind(build) for name, build in _QUERIES.items()}
