"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; safe to call repeatedly."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        # a repeated key takes its last value
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="auditloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by writing to the shared checkpoint folder.

    The rows are computed once and read back from storage, so a lost executor
    can neither change nor repeat a sampled range partitioning.
    """
    if getattr(df, "_stored", False):
        return df
    scratch_dir(df.sparkSession)
    stored = df.checkpoint(eager=True)
    stored._stored = True
    return stored


def kept(df: DataFrame) -> DataFrame:
    """A table in the shared folder, by columns: for large tables that are read in part or often."""
    return kept_in_turns(lambda _: df, 1)


#: Whether a job's shuffle files are removed when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How hard a table is compressed: by default, and where it is large and read once.
ZSTD, ZSTD_HARD = 3, 9


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """What a write inside has shuffled is removed with its end."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def kept_in_turns(make: Callable[[int], DataFrame], turns: int, level: int = ZSTD) -> DataFrame:
    """``make(0)`` to ``make(turns - 1)`` as one table in the shared folder, written one after the other.

    The table is compressed, and what a write has shuffled is removed with its end, so the disk holds
    the shuffle of one turn at a time.
    """
    path = None
    for turn in range(turns):
        df = make(turn)
        spark = df.sparkSession
        path = path or f"{scratch_dir(spark)}/kept-{uuid.uuid4().hex}"
        writer = df.write.mode("append").option("compression", "zstd")
        with cleaned_up(spark):
            writer.option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def kept_by(df: DataFrame, key: str) -> DataFrame:
    """A table in the shared folder, dealt by ``key``: a join on it moves the other side only."""
    spark = df.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name.replace('_', '-')}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(count, key).sortBy(key).option("compression", "zstd").option("path", path)
    with cleaned_up(spark):
        writer.saveAsTable(name)
    out = spark.table(name)
    out._folder, out._table = path, name
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``kept``, ``kept_in_turns`` or ``kept_by`` that nothing will read again."""
    spark = df.sparkSession
    if name := getattr(df, "_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes of rows that may be sent to every task.
BROADCAST_BYTES = 32 << 20


def fitting(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its rows, measured, are within the bound."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16 + 8 * len(df.columns)))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread an input of few splits over all cores before heavy per-row work.

    Fewer splits than cores means a small input, so the shuffle is small too; a
    large table already has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
