"""A finished run as files with names, and reading them back.

``run_files`` turns the tables of a run into (path, content) rows, ``sources.named`` puts
them in place.  Below ``run=<run id>``:

- ``summary.json``, ``results/<slug>.json``, ``triage/T0001_….json``
- ``summary.md``, ``pr-comment.md``, ``triage_survivors.md``
- ``reports/<slug>.md``, ``contexts/<slug>.context.md``, ``triages/T0001_….md``,
  ``findings/VULN-001_….md``
- ``results.sarif``

What grows with a run is cut into pages of bounded size: the second page of ``summary.md`` is
``summary-0002.md``.  Files whose slugs collide get ``~2``, ``~3`` and so on, in order of
display name; a slug itself never holds that sign.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import safe_name
from ..operators.ranking import numbered
from .named import write_files
from .sinks import FORMATS

#: Lines of a page.
PAGE_LINES = 10_000
FOLDERS = {"triage": "triages", "finding": "findings", "report": "reports", "context": "contexts"}


def run_folder(run_id: Column) -> Column:
    return F.concat(F.lit("run="), F.url_encode(run_id))


def _page_name(stem: str, suffix: str, page: Column) -> Column:
    """page counts from 0; the first has the plain name."""
    return F.when(page == 0, F.lit(f"{stem}{suffix}")).otherwise(
        F.format_string(f"{stem}-%04d{suffix}", (page + 1).cast("int"))
    )


def _path(*parts: Column) -> Column:
    return F.concat_ws("/", run_folder(F.col("run_id")), *parts).alias("path")


def pages(rows: DataFrame, order: list[str], text: str, stem: str, separator: str, end: str = "") -> DataFrame:
    """Ordered rows of each run as pages: (path, content).

    ``order`` tells a run's rows apart.  Only its columns are ranked; a page's texts meet
    in one place, and a page is bounded.
    """
    numbers = numbered(rows, ["run_id"], [F.col(c) for c in order], "_line", ["run_id", *order])
    page = F.expr(f"(_line - 1) div {PAGE_LINES}")
    whole = (
        numbers.groupBy("run_id", page.alias("_page"))
        .agg(F.array_sort(F.collect_list(F.struct("_line", F.col(text).alias("t"))))["t"].alias("_texts"))
    )
    joined = F.concat(F.array_join("_texts", separator), F.lit(end))
    return whole.select(_path(_page_name(stem, ".md", F.col("_page"))), joined.alias("content"))


def unique_slugs(files: DataFrame) -> DataFrame:
    """(run_id, file_id, slug): names that differ within a run.

    Only files that share a slug are put in order.
    """
    slugged = files.select("run_id", "file_id", "display_name", safe_name(F.col("display_name")).alias("slug"))
    shared = slugged.groupBy("run_id", "slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same = slugged.join(shared, ["run_id", "slug"], "left_semi")
    placed = numbered(
        same, ["run_id", "slug"], [F.col("display_name"), F.col("file_id")], "_same", ["run_id", "file_id", "slug"]
    ).select("run_id", "file_id", "_same")
    tail = F.when(F.col("_same") > 1, F.concat(F.lit("~"), F.col("_same").cast("string"))).otherwise("")
    return slugged.join(placed, ["run_id", "file_id"], "left").select(
        "run_id", "file_id", F.concat("slug", F.coalesce(tail, F.lit(""))).alias("slug")
    )


def summary_json(summary: DataFrame, gate: DataFrame, stamp: str, target: str, model: str, min_confidence: float) -> DataFrame:
    """One object a run; its files, decisions and failures stand in files of their own."""
    joined = summary.join(gate.select("run_id", "should_fail", "failures"), "run_id")
    wall = F.col("wall_s") if "wall_s" in summary.columns else F.lit(0.0)
    value = F.struct(
        F.lit(stamp).alias("timestamp"), F.lit(target).alias("target"), F.lit(model).alias("model"),
        "files_scanned", "files_skipped", "total_lines", wall.alias("wall_time_seconds"),
        "critical_files", "high_files", "clean_files", "error_files",
        "should_fail", "failures", F.lit(min_confidence).alias("min_confidence"),
    )
    return joined.select(_path(F.lit("summary.json")), F.to_json(value).alias("content"))


def _some(column: str, kind: str = "text") -> Column:
    """A value that JSON leaves out when it is empty."""
    empty = F.col(column) == ("" if kind == "text" else 0)
    return F.when(~empty, F.col(column)).alias(column)


def result_json(results: DataFrame, slugs: DataFrame, stamp: str, model: str) -> DataFrame:
    """One object an ``ok`` file, ``results`` being ``reports.nested_results``."""
    have = set(results.columns)
    texts = [_some(c) for c in ("context", "report") if c in have]
    counts = [
        _some(c, "number")
        for c in ("context_tokens", "prompt_tokens", "completion_tokens", "total_tokens", "context_elapsed", "scan_elapsed", "total_elapsed")
        if c in have
    ]
    plain = [F.col(c) for c in ("lines", "chars") if c in have]
    value = F.struct(
        F.coalesce("path", "display_name").alias("file") if "path" in have else F.col("display_name").alias("file"),
        "display_name", F.lit(model).alias("model"), *texts, "findings", "severities", "status", *counts, *plain,
        F.lit(stamp).alias("timestamp"),
    )
    return (
        results.filter(F.col("status") == "ok")
        .join(slugs, ["run_id", "file_id"])
        .select(_path(F.lit("results"), F.concat("slug", F.lit(".json"))), F.to_json(value).alias("content"))
    )


def triage_json(ordered: DataFrame) -> DataFrame:
    """One object a decision; ``ordered`` is ``nested_triage`` with its position."""
    name = F.format_string(fixed.TRIAGE_NAME.removesuffix(".md") + ".json", "position", safe_name(F.col("file")), safe_name(F.col("title")))
    kept = [c for c in ordered.columns if c not in ("run_id", "position")]
    return ordered.select(_path(F.lit("triage"), name), F.to_json(F.struct(*kept)).alias("content"))


def single_documents(details: DataFrame, kind: str) -> DataFrame:
    """Documents of one kind under their names."""
    of_kind = details.filter(F.col("kind") == kind)
    return of_kind.select(_path(F.lit(FOLDERS[kind]), F.col("name")), F.col("text").alias("content"))


def documents(details: DataFrame, kinds: Iterable[str] = tuple(FOLDERS)) -> list[DataFrame]:
    """Documents of files, decisions and survivors under their names, kind by kind, and the survivors' overview."""
    overview = pages(details.filter("kind = 'survivors'"), ["position"], "text", "triage_survivors", "")
    return [*[single_documents(details, kind) for kind in kinds], overview]


def sarif_files(logs: DataFrame) -> DataFrame:
    return logs.select(_path(_page_name("results", ".sarif", F.col("shard"))), F.col("sarif").alias("content"))


def write_outputs(out: str, parts: dict[str, list[DataFrame]], formats: Iterable[str] = FORMATS) -> None:
    """Write the (path, content) rows of the chosen formats (json, markdown, sarif).

    One table after the other, so that the disk holds the shuffle of one at a time; the files of a
    table are moved into place when all of them are written.
    """
    chosen = tuple(formats) or FORMATS
    for name in FORMATS:
        for rows in parts.get(name, []) if name in chosen else []:
            write_files(rows, out)
