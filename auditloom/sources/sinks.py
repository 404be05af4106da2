"""Run outputs: JSON, Markdown and SARIF, partitioned by run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "markdown", "sarif")


def parse_formats(value: str) -> tuple[str, ...]:
    """Comma list, case and blanks ignored; nothing selected means everything."""
    names = tuple(p.strip().lower() for p in value.split(",") if p.strip())
    return names or FORMATS


def write_run(
    out: str,
    summary: DataFrame,
    results: DataFrame,
    triage: DataFrame,
    pages: DataFrame,
    documents: DataFrame,
    sarif: DataFrame,
    formats: Iterable[str] = FORMATS,
) -> list[str]:
    """Write the selected formats below ``out``; returns the folders written.

    Only partitions of the runs being written are replaced.  Files with errors
    get no per-file output.
    """
    chosen = tuple(formats) or FORMATS
    written = []

    def put(df: DataFrame, name: str, kind: str, ordered: bool = False) -> None:
        path = f"{out}/{name}"
        # one run's rows together, large runs split and small ones joined by their size
        rows = df if ordered else df.hint("rebalance", "run_id")
        writer = rows.write.mode("overwrite").partitionBy("run_id")
        writer.option("partitionOverwriteMode", "dynamic").format(kind).save(path)
        written.append(path)

    if "json" in chosen:
        put(summary, "summary", "json")
        put(results.filter(F.col("status") == "ok"), "results", "json")
        put(triage, "triage", "json")
    if "markdown" in chosen:
        # range partitioning keeps the lines of a page in order over its files
        lines = pages.repartitionByRange("run_id", "section", "position")
        put(lines.sortWithinPartitions("run_id", "section", "position"), "pages", "parquet", ordered=True)
        put(documents, "documents", "parquet")
    if "sarif" in chosen:
        put(sarif.select("run_id", F.col("sarif").alias("value")), "sarif", "text")
    return written
