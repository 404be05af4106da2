"""Corpus scope: which files of a tree are reviewed, and why the others are not.

``files`` has (run_id, path, content) and may carry listing columns ``length``
(bytes) and ``kind`` (``file``, ``symlink``, ``directory``, ``unreadable``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import durable
from .ranking import numbered


def _size(df: DataFrame) -> Column:
    if "length" in df.columns:
        return F.col("length")
    return F.octet_length("content")


def _ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def _has_nul(df: DataFrame) -> Column:
    if dict(df.dtypes)["content"] == "binary":
        return F.contains("content", F.lit(b"\x00"))
    return F.contains("content", F.char(F.lit(0)))


def prune_dirs(
    files: DataFrame, excluded: Iterable[str] = fixed.EXCLUDED_DIRS, root: str | None = None
) -> DataFrame:
    """Drop files of a walked tree that lie under an excluded directory.

    With ``root``, directories above it do not count but the root itself does.
    Leaves no ledger row.
    """
    names = "|".join(n.replace(".", r"\.") for n in excluded)
    below = F.col("path")
    if root is not None:
        parent = root.rstrip("/").rpartition("/")[0]
        below = F.substring(below, F.lit(len(parent) + 1), F.length(below))
    return files.filter(~below.rlike(f"(?:^|/)(?:{names})/"))


def ext_filter(files: DataFrame, extensions: Iterable[str] = fixed.EXTENSIONS) -> DataFrame:
    return files.filter(_ext(F.col("path")).isin(*extensions))


def size_gate(files: DataFrame, max_bytes: int = fixed.MAX_BYTES) -> DataFrame:
    limit = max_bytes if max_bytes > 0 else fixed.MAX_BYTES
    return files.filter(_size(files) <= limit)


def binary_gate(files: DataFrame) -> DataFrame:
    return files.filter(~_has_nul(files))


def ignore_antijoin(
    files: DataFrame, ignored: DataFrame | None, repo: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split into (kept, ledger rows) by the ignored repo-relative paths.

    Paths outside ``repo`` are never ignored; no list means everything is kept.
    """
    if ignored is None:
        return files, files.filter(F.lit(False)).select("run_id", "path", F.lit("gitignore").alias("reason"))
    relative = F.col("path")
    if repo is not None:
        prefix = repo.rstrip("/") + "/"
        inside = F.startswith("path", F.lit(prefix))
        relative = F.when(inside, F.substring("path", F.lit(len(prefix) + 1), F.length("path")))
    keyed = files.withColumn("_rel", relative)
    listed = ignored.select("run_id", F.col("path").alias("_rel"))
    kept = keyed.join(listed, ["run_id", "_rel"], "left_anti").select(*files.columns)
    dropped = keyed.join(listed, ["run_id", "_rel"], "left_semi")
    return kept, dropped.select("run_id", "path", F.lit("gitignore").alias("reason"))


def _clean_path(path: Column) -> Column:
    """Lexically shortest form: no empty or ``.`` parts; ``..`` removes its parent."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    start = F.expr("cast(array() as array<string>)")
    kept = F.aggregate(
        parts,
        start,
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, p)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def changed_scope(changed: DataFrame, roots: DataFrame, repo: str) -> DataFrame:
    """Changed paths equal to or below a root: absolute, clean, distinct, sorted.

    Each path is compared with roots through its own ancestors, an equi-join, so
    the number of roots does not multiply the number of paths.
    """
    base = F.lit(repo.rstrip("/") + "/")
    absolute = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(
        F.concat(base, F.col("path"))
    )
    paths = (
        changed.filter(F.coalesce(F.col("path"), F.lit("")) != "")
        .select("run_id", _clean_path(absolute).alias("path"))
        .distinct()
    )
    parts = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    up = paths.select("run_id", "path", F.explode(ancestors).alias("root"))
    wanted = roots.select("run_id", _clean_path(F.col("root")).alias("root"))
    return (
        up.join(wanted, ["run_id", "root"], "left_semi")
        .select("run_id", "path")
        .distinct()
        .orderBy("run_id", "path")
    )


def snapshot_diff(head: DataFrame, base: DataFrame) -> DataFrame:
    """Paths added or modified from base to head; deletes and exact renames excluded.

    A deleted file explains one added file of its content, no more: of the added paths
    of one content the first ones, in order, count as renames, as many as were deleted.
    """
    new = head.select("run_id", "path", F.sha2("content", 256).alias("digest"))
    old = base.select("run_id", "path", F.sha2("content", 256).alias("digest"))
    before = old.select("run_id", "path", F.col("digest").alias("old_digest"))
    touched = (
        new.join(before, ["run_id", "path"], "left")
        .filter(F.col("old_digest").isNull() | (F.col("digest") != F.col("old_digest")))
        .withColumn("change", F.when(F.col("old_digest").isNull(), "A").otherwise("M"))
    )
    deleted = (
        old.join(new, ["run_id", "path"], "left_anti")
        .groupBy("run_id", "digest")
        .agg(F.count(F.lit(1)).alias("n_deleted"))
        .withColumn("change", F.lit("A"))
    )
    # only contents that were deleted somewhere are put in order, in pieces of any size
    paired = touched.join(deleted, ["run_id", "digest", "change"])
    left_over = numbered(paired, ["run_id", "digest"], [F.col("path")], "rn").filter("rn > n_deleted")
    plain = touched.join(deleted, ["run_id", "digest", "change"], "left_anti")
    columns = ["run_id", "path", "change"]
    return plain.select(*columns).unionByName(left_over.select(*columns))


def _line_feeds(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")


def with_skip_reason(
    files: DataFrame,
    ignored: DataFrame | None,
    extensions: Iterable[str] = fixed.EXTENSIONS,
    max_bytes: int = fixed.MAX_BYTES,
) -> DataFrame:
    """(run_id, path, lines, chars, reason): the first rule that drops the file.

    ``reason`` is null for kept files.  Content is measured before the join with
    the ignore list, so it is never shuffled.
    """
    limit = max_bytes if max_bytes > 0 else fixed.MAX_BYTES
    size = _size(files)
    kind = F.col("kind") if "kind" in files.columns else F.lit("file")
    measured = files.select(
        "run_id",
        "path",
        _line_feeds(F.col("content").cast("string")).alias("lines"),
        F.octet_length("content").alias("chars"),
        F.when(kind.isin("unreadable", "symlink", "directory"), kind)
        .when(~_ext(F.col("path")).isin(*extensions), "extension")
        .when(size > limit, F.format_string(fixed.TOO_LARGE, size.cast("long")))
        .when(F.col("content").isNull(), "unreadable")
        .when(_has_nul(files), "binary")
        .alias("reason"),
    )
    if ignored is None:
        return measured
    listed = ignored.select("run_id", "path", F.lit(True).alias("_ignored")).distinct()
    return measured.join(listed, ["run_id", "path"], "left").select(
        "run_id",
        "path",
        "lines",
        "chars",
        F.when(F.col("_ignored"), F.lit("gitignore")).otherwise(F.col("reason")).alias("reason"),
    )


def skip_ledger(files: DataFrame, ignored: DataFrame | None, **rules) -> DataFrame:
    """One row per dropped file, sorted by path."""
    dropped = with_skip_reason(files, ignored, **rules).filter(F.col("reason").isNotNull())
    # stored before the sort samples it, so that contents are read once
    return durable(dropped.select("run_id", "path", "reason")).orderBy("run_id", "path")


def skip_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("run_id", "reason").agg(F.count(F.lit(1)).alias("n_files"))


def display_name(base: str | None) -> Column:
    """The path relative to ``base``; one outside it stays as it is."""
    if base is None:
        return F.col("path")
    prefix = base.rstrip("/") + "/"
    return F.when(
        F.startswith("path", F.lit(prefix)), F.substring("path", F.lit(len(prefix) + 1), F.length("path"))
    ).otherwise(F.col("path"))


def source_profile(files: DataFrame, base: str | None = None) -> DataFrame:
    """lines (count of line feeds), chars (bytes), display name; sorted by it."""
    text = F.col("content").cast("string")
    measured = files.select(
        "run_id",
        "path",
        display_name(base).alias("display_name"),
        _line_feeds(text).alias("lines"),
        F.octet_length(text).cast("int").alias("chars"),
    )
    # sorting samples its input first: stored, so that contents are read once
    return durable(measured).orderBy("run_id", "display_name")


def corpus_totals(runs: DataFrame, classified: DataFrame) -> DataFrame:
    """files, skipped and total lines per run; a run without files is a zero row.

    ``classified`` is ``with_skip_reason`` output; aggregated before the join.
    """
    kept = F.col("reason").isNull()
    per_run = classified.groupBy("run_id").agg(
        F.count_if(kept).alias("files"),
        F.count_if(~kept).alias("skipped"),
        F.sum(F.when(kept, F.col("lines")).cast("long")).alias("total_lines"),
    )
    zero = F.lit(0).cast("long")
    return runs.join(per_run, "run_id", "left").select(
        "run_id", *[F.coalesce(F.col(c), zero).alias(c) for c in ("files", "skipped", "total_lines")]
    )


def corpus_lines(files: DataFrame) -> DataFrame:
    """(run_id, path, line, text): the searchable form of the corpus."""
    text = F.col("content").cast("string")
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    pieces = F.when(text != "", F.split(body, "\n"))
    return files.select("run_id", "path", F.posexplode(pieces).alias("pos", "raw")).select(
        "run_id",
        "path",
        (F.col("pos") + 1).alias("line"),
        F.when(F.endswith("raw", F.lit("\r")), F.substring("raw", F.lit(1), F.length("raw") - 1))
        .otherwise(F.col("raw"))
        .alias("text"),
    )
