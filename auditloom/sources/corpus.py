"""Reading source trees.

``binary_files`` reads any Hadoop file system but, like every Spark file source,
leaves out names that start with ``_`` or ``.``.  ``list_tree`` and
``read_contents`` walk a mounted POSIX tree in tasks and keep every name; they also
tell symbolic links and unreadable entries apart.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import durable

LISTING = "run_id string, root string, path string, kind string, length long"


def binary_files(spark: SparkSession, run_id: str, roots: list[str]) -> DataFrame:
    """run_id, path, length, content of all files below the roots, each file once.

    A root at or below another one is left out before reading, so nothing is read twice.
    """
    tops = sorted({r.rstrip("/") or "/" for r in roots})
    apart = [r for r in tops if not any(r.startswith(o.rstrip("/") + "/") for o in tops if o != r)]
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(apart)
        .select(
            F.lit(run_id).alias("run_id"),
            F.regexp_replace("path", r"^file:/+", "/").alias("path"),
            "length",
            "content",
        )
    )


def list_tree(roots: DataFrame, excluded: Iterable[str] = fixed.EXCLUDED_DIRS) -> DataFrame:
    """Files below (run_id, root), one level of directories per step.

    Excluded directories are not entered, also when a root itself is so named; a
    root that is a file is taken as it is.  Overlapping roots give each file once.
    """
    skipped = frozenset(excluded)

    def kind_of(info: os.stat_result) -> str:
        if stat.S_ISLNK(info.st_mode):
            return "symlink"
        return "directory" if stat.S_ISDIR(info.st_mode) else "file"

    def look(run: str, root: str, path: str) -> tuple:
        try:
            info = os.lstat(path)
        except OSError:
            return run, root, path, "unreadable", None
        return run, root, path, kind_of(info), info.st_size

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["run_id", "root", "path", "kind", "length"]).astype(
            {"length": "Int64"}
        )

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame([look(run, root, root) for run, root in zip(batch["run_id"], batch["root"])])

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run, root, path in zip(batch["run_id"], batch["root"], batch["path"]):
                rows = []
                try:
                    with os.scandir(path) as entries:
                        for entry in entries:
                            rows.append(look(run, root, entry.path))
                            if len(rows) == 10_000:
                                yield frame(rows)
                                rows = []
                except OSError:
                    pass  # a directory that cannot be listed has no files
                yield frame(rows)

    name = F.regexp_extract("path", r"([^/]+)/*\z", 1)
    parallel = roots.sparkSession.sparkContext.defaultParallelism
    level = durable(roots.select("run_id", "root").mapInPandas(start, LISTING))
    found = None
    while True:
        files = level.filter("kind <> 'directory'")
        found = files if found is None else found.unionByName(files)
        inner = level.filter((F.col("kind") == "directory") & ~name.isin(*skipped))
        if inner.isEmpty():
            break
        level = durable(inner.repartition(parallel).mapInPandas(enter, LISTING))
    return found.dropDuplicates(["run_id", "path"])


def read_contents(listing: DataFrame, max_bytes: int = fixed.MAX_BYTES) -> DataFrame:
    """Add ``content`` to listed files within the size limit; others keep null.

    Filter by extension and ignore list first: only what is left is opened.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64].copy()
                texts = []
                for path, kind, length in zip(part["path"], part["kind"], part["length"]):
                    content = None
                    if kind == "file" and length <= max_bytes:
                        try:
                            with open(path, "rb") as handle:
                                content = handle.read()
                        except OSError:
                            pass
                    texts.append(content)
                part["content"] = texts
                yield part

    return listing.mapInPandas(load, LISTING + ", content binary")
