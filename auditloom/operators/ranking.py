"""Row numbers and running sums that survive one huge group.

A window partitioned by the group puts the whole group into one task.  Here the
rows are range-partitioned by (group, order keys) instead, so a hot group is cut
into as many pieces as it needs.  The pieces are written once (``durable``), each
row's place inside its piece is known from its id, and a small table with one row
per (group, piece) carries the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def _placed(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    # range partitioning reads its input twice (sample, then shuffle): read it from storage
    stored = durable(df)
    rows = stored.orderBy(*group, *order).withColumn("_slot", F.monotonically_increasing_id())
    # the upper bits of the id are the partition, the lower 33 the place in it
    return durable(rows).withColumn("_piece", F.shiftright("_slot", 33))


def _earlier(group: list[str]):
    return (
        Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )


def numbered(
    df: DataFrame,
    group: list[str],
    order: list[Column | tuple[Column, bool]],
    name: str,
    keys: list[str] | None = None,
) -> DataFrame:
    """Add ``name``: 1, 2, … per group in the given total order.

    A column in ``order`` may be paired with True: falling.  With ``keys``, columns that tell the rows apart (the group among them), only keys and
    order are moved and stored; the number is joined back to the rows, whose texts stay
    where they are until something asks for them.
    """
    pairs = [o if isinstance(o, tuple) else (o, False) for o in order]
    if keys is None:
        return _numbered(df, group, [c.desc() if down else c for c, down in pairs], name)
    sort = [f"_o{i}" for i in range(len(pairs))]
    narrow = df.select(*keys, *[c.alias(n) for n, (c, _) in zip(sort, pairs)])
    by = [F.col(n).desc() if down else F.col(n) for n, (_, down) in zip(sort, pairs)]
    ranks = _numbered(narrow, group, by, name).select(*keys, name)
    return df.join(ranks, keys)


def _numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    placed = _placed(df, group, order)
    pieces = placed.groupBy(*group, "_piece").agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    offsets = pieces.select(
        *group,
        "_piece",
        "_first",
        F.coalesce(F.sum("_n").over(_earlier(group)), F.lit(0)).alias("_before"),
    )
    return (
        placed.join(offsets, [*group, "_piece"])
        .withColumn(name, F.col("_before") + F.col("_slot") - F.col("_first") + 1)
        .drop("_piece", "_slot", "_first", "_before")
    )


def running_sums(
    df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]
) -> DataFrame:
    """Add cumulative sums per group: ``{new column: summed column}``."""
    placed = _placed(df, group, order)
    pieces = placed.groupBy(*group, "_piece").agg(
        *[F.sum(src).alias(f"_sum_{out}") for out, src in sums.items()]
    )
    offsets = pieces.select(
        *group,
        "_piece",
        *[
            F.coalesce(F.sum(f"_sum_{out}").over(_earlier(group)), F.lit(0)).alias(f"_before_{out}")
            for out in sums
        ],
    )
    inside = (
        Window.partitionBy(*group, "_piece")
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = placed.select("*", *[F.sum(src).over(inside).alias(f"_in_{out}") for out, src in sums.items()])
    joined = local.join(offsets, [*group, "_piece"])
    keep = [c for c in df.columns]
    return joined.select(
        *keep, *[(F.col(f"_in_{out}") + F.col(f"_before_{out}")).alias(out) for out in sums]
    )
