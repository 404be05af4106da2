"""Severity and verdict expressions (normalise, rank, threshold, levels)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import trimmed


def normalize_severity(col: Column) -> Column:
    """Trim and lower; anything unknown, blank or null is ``medium``."""
    word = F.lower(trimmed(col))
    known = (*fixed.SEVERITIES, fixed.CLEAN)
    return F.when(word.isin(*known), word).otherwise(F.lit("medium"))


def severity_rank(col: Column) -> Column:
    """0 for critical up to 4 for informational; everything else is 5."""
    rank = F.lit(len(fixed.SEVERITIES))
    for i, name in reversed(list(enumerate(fixed.SEVERITIES))):
        rank = F.when(col == name, F.lit(i)).otherwise(rank)
    return rank


def threshold_rank(threshold: str) -> int:
    """Rank of a user-given threshold; unknown words mean ``medium``."""
    word = threshold.strip().lower()
    if word == fixed.CLEAN:
        return len(fixed.SEVERITIES)
    return fixed.SEVERITIES.index(word if word in fixed.SEVERITIES else "medium")


def at_or_above(col: Column, threshold: str) -> Column:
    return severity_rank(col) <= threshold_rank(threshold)


def top_severity(counts: dict[str, Column]) -> Column:
    """Highest severity whose count is positive, else ``clean``."""
    return F.coalesce(
        *[F.when(counts[name] > 0, F.lit(name)) for name in fixed.SEVERITIES], F.lit(fixed.CLEAN)
    )


def sarif_level(col: Column) -> Column:
    level = F.lit("none")
    for name, value in fixed.SARIF_LEVELS.items():
        level = F.when(col == name, F.lit(value)).otherwise(level)
    return level


def verdict_letter(col: Column) -> Column:
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit("?")).otherwise(F.left(col, F.lit(1)))


def unit_interval(value: float, name: str) -> float:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must be between 0 and 1")
    return float(value)


def one_of(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"unsupported {name} {value!r}")
    return value
