"""Quality rules from the frequency of lines across documents (native).

Every line is normalised and hashed.  A line is boilerplate on a host when more than
``share`` of the host's distinct documents, and at least ``min_docs`` of them, hold it.
Boilerplate lines are removed; a document that loses more than ``max_removed_pct``
per cent of its words is depleted and rejected, as is one that fails the base rules.

Defined results.  A null text has no words, so it fails; a null host counts as the empty
host.  Documents of equal text count once towards a line, so copies never make their own
lines boilerplate.  Repeated rows are rated alike and all returned.  An empty table gives
an empty result.  Input columns other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, spread_join, stored, words_of

#: Limits of the base rules and of the line rule.
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_DOCS = 5
SHARE_PCT = 10
MAX_REMOVED_PCT = 50

SYMBOLS = "[#*$%&|<>]"


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows found twice or more in the text."""
    windows = let(
        words,
        lambda w: F.when(
            F.size(w) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")
                ),
            ),
        ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")),
    )
    repeated = let(
        F.sort_array(windows),
        lambda s: F.transform(
            F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            ),
            lambda x: x["at"],
        ),
    )
    # a window covers its three words, less those the next repeated window covers too
    covered = let(
        F.sort_array(repeated),
        lambda p: F.transform(
            p, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - at, F.lit(3)))
        ),
    )
    return F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("bigint")


def _wordy_lines(text: Column) -> Column:
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    )


def normal_line(line: Column) -> Column:
    """Lower case, single blanks, every number alike."""
    flat = F.trim(F.regexp_replace(F.lower(line), f"{BLANKS}+", " "))
    return F.regexp_replace(flat, "[0-9]+", "0")


def base_measures(text: Column) -> dict[str, Column]:
    """The measures of one text."""
    full = F.coalesce(text, F.lit(""))
    lines = _wordy_lines(text)
    return {
        "n_words": F.size(words_of(text)).cast("bigint"),
        "word_chars": F.length(F.regexp_replace(full, BLANKS, "")).cast("bigint"),
        "n_symbols": F.regexp_count(full, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeat_words(words_of(text)),
    }


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col), F.lit(""))


def frequent_lines(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    share_pct: int = SHARE_PCT,
) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, sorted.

    A host has at most 100 / ``share_pct`` times as many of them as its documents have
    lines on average, since each is on that share of its documents.
    """
    lines = docs.select(
        _host(host_col).alias("host"),
        F.xxhash64(text_col).alias("digest"),
        F.explode(
            F.array_distinct(F.transform(_wordy_lines(F.col(text_col)), lambda x: F.xxhash64(normal_line(x))))
        ).alias("line"),
    )
    counts = (
        lines.groupBy("host", "line", "digest")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line")
        .agg(F.count("one").alias("n"))
        .filter(F.col("n") >= min_docs)
    )
    hosts = (
        docs.select(_host(host_col).alias("host"), F.xxhash64(text_col).alias("digest"))
        .groupBy("host", "digest")
        .agg(F.lit(1).alias("one"))
        .groupBy("host")
        .agg(F.count("one").alias("host_docs"))
    )
    return (
        spread_join(counts, hosts, ["host"], F.col("line"))
        .filter(100 * F.col("n") > share_pct * F.col("host_docs"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
    )


def _marked(docs: DataFrame, text_col: str, host_col: str, frequent: DataFrame) -> DataFrame:
    """The documents with ``_lf_lines``, the boilerplate of their host.

    The stored side's size is known, so Spark sends it to all tasks while it is small and
    the texts stay where they are; beyond that it shuffles and splits large hosts.
    """
    keyed = frequent.select(F.col("host").alias("_lf_host"), F.col("lines").alias("_lf_lines"))
    return docs.join(keyed, _host(host_col) == F.col("_lf_host"), "left")


def _is_boilerplate(line: Column) -> Column:
    return F.coalesce(F.array_contains("_lf_lines", F.xxhash64(normal_line(line))), F.lit(False))


def _rating(text_col: str, max_removed_pct: int) -> dict[str, Column]:
    """The measures and verdicts of a document with its host's boilerplate lines."""
    measures = base_measures(F.col(text_col))
    gone = F.filter(_wordy_lines(F.col(text_col)), _is_boilerplate)
    removed = F.aggregate(
        F.transform(gone, lambda x: F.size(words_of(x))), F.lit(0), lambda a, b: a + b
    ).cast("bigint")
    measures["removed_words"] = F.when(F.col("_lf_lines").isNull(), F.lit(0)).otherwise(removed)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")
    )
    spared = 100 * F.col("removed_words") <= max_removed_pct * F.col("n_words")
    return measures | {"base_failed": failed, "kept": ~failed & spared}


def rate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    share_pct: int = SHARE_PCT,
    max_removed_pct: int = MAX_REMOVED_PCT,
) -> DataFrame:
    """One row per document: id, measures, removed_words, base_failed and kept."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_host"))
    frequent = stored(frequent_lines(narrow, "_text", "_host", min_docs, share_pct))
    rating = _rating("_text", max_removed_pct)
    verdicts = {k: rating.pop(k) for k in ("base_failed", "kept")}
    rated = _marked(narrow, "_text", "_host", frequent).select("id", *[c.alias(k) for k, c in rating.items()])
    return rated.select("*", verdicts["base_failed"].alias("base_failed"), verdicts["kept"].alias("kept"))


def clean(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """The kept documents, same columns, without their boilerplate lines."""
    names = [f"_lf_{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)  # so that no column of the documents meets one of the rating
    text, host = (names[docs.columns.index(c)] for c in (text_col, host_col))
    frequent = stored(frequent_lines(plain, text, host))
    rating = _rating(text, MAX_REMOVED_PCT)
    kept = rating.pop("kept")
    rating.pop("base_failed")
    rated = _marked(plain, text, host, frequent).select("*", *[c.alias(k) for k, c in rating.items()]).filter(kept)
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~_is_boilerplate(x)), "\n")
    cleaned = F.when(F.col("removed_words") == 0, F.col(text)).otherwise(left)
    return rated.select(*[(cleaned if n == text else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])
