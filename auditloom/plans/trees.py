"""The given table's files as a tree on the shared file system, for the queries that read one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, scratch_dir
from ..sources.named import write_files
from ..sources.outputs import run_folder

#: What stands in front of a path of the tree.
BASE = r"^.*/tree-[0-9a-f]{32}/run=[^/]*/"


def tree_files(files: DataFrame) -> DataFrame:
    """(run_id, path, content): the files, some once more under hidden names, one a run apart."""
    hidden = files.filter("file_id % 5 = 0").withColumn(
        "path", F.concat(F.lit("repo/.github/_f"), F.col("file_id").cast("string"), F.lit(".c"))
    )
    single = (
        files.groupBy("run_id")
        .agg(F.min("file_id").alias("file_id"))
        .join(files.select("run_id", "file_id", "content"), ["run_id", "file_id"])
        .withColumn("path", F.lit("apart/single.c"))
    )
    columns = ["run_id", "path", "content"]
    return files.select(*columns).unionByName(hidden.select(*columns)).unionByName(single.select(*columns))


def write_tree(files: DataFrame) -> tuple[str, dict[str, list[str]]]:
    """(folder, roots by run): each run's ``repo`` directory, and one file that is a root."""
    folder = f"{scratch_dir(files.sparkSession)}/tree-{uuid.uuid4().hex}"
    rows = tree_files(files)
    write_files(
        rows.select(F.concat_ws("/", run_folder(F.col("run_id")), "path").alias("path"), F.col("content").cast("binary")),
        folder,
    )
    # one row a run: the roots are an argument of the reader
    runs = durable(files.select("run_id").distinct().select("run_id", run_folder(F.col("run_id")).alias("at")))
    roots = {r.run_id: [f"{folder}/{r.at}/repo", f"{folder}/{r.at}/apart/single.c"] for r in runs.collect()}
    return folder, roots


def inside(path: Column) -> Column:
    """The path inside its run's folder."""
    return F.regexp_replace(path, BASE, "")
