"""Text helpers, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it.

    Lambda bodies and CASE branches would otherwise evaluate it at each use.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trimmed(col: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(fixed.TRIM_CHARS))


def blank_to_null(col: Column) -> Column:
    return F.when(trimmed(col) != "", col)


def byte_prefix(col: Column, limit: int) -> Column:
    """First ``limit`` bytes of a string, never ending inside a character."""

    def cut(text: Column) -> Column:
        raw = text.cast("binary")

        def continues(pos: int) -> Column:
            # bytes 80..BF are the inside of a character
            return F.substring(F.hex(F.substring(raw, pos, 1)), 1, 1).isin("8", "9", "A", "B")

        size = F.lit(limit - 3)
        for back in (2, 1, 0):
            size = F.when(~continues(limit - back + 1), F.lit(limit - back)).otherwise(size)
        return F.when(F.octet_length(text) <= limit, text).otherwise(
            F.substring(raw, F.lit(1), size).cast("string")
        )

    return let(col, cut)


def truncate_text(col: Column, limit: int) -> Column:
    """Trim; when longer than ``limit`` characters, shorten and mark the cut."""

    def cut(text: Column) -> Column:
        if limit < 20:
            short = trimmed(F.left(text, F.lit(limit)))
        else:
            short = F.concat(trimmed(F.left(text, F.lit(limit - 15))), F.lit(fixed.TRUNCATED))
        return F.when(F.length(text) <= limit, text).otherwise(short)

    return trimmed(col) if limit <= 0 else let(trimmed(col), cut)


def safe_name(col: Column) -> Column:
    """File-name slug of any text."""
    slug = F.regexp_replace(col, r"[/\\]", "_")
    slug = F.regexp_replace(slug, r"[^A-Za-z0-9_.\-]+", "_")
    slug = F.btrim(slug, F.lit("_"))
    # only ASCII is left, so characters are bytes
    return F.when(slug == "", F.lit("unnamed")).otherwise(F.left(slug, F.lit(fixed.MAX_SLUG_BYTES)))


def table_cell(col: Column) -> Column:
    return trimmed(F.replace(F.replace(col, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))


def half_up(col: Column, scale: int) -> Column:
    """Round half up by cutting, as DOUBLE: scale 10 keeps one digit, 100 two."""
    return F.floor(col * F.lit(float(scale)) + F.lit(0.5)).cast("double") / F.lit(float(scale))


def digest_id(*parts: Column) -> Column:
    """Stable 128-bit key; wide enough to stay unique over any number of runs."""
    return F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))


def run_stamp(ts: Column) -> Column:
    """The time a run started, as it is written in file names and reports."""
    return F.date_format(ts, "yyyy-MM-dd_HHmmss")
