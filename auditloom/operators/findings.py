"""Findings from free-form reports: four tiers, one pass over the reports.

Every tier is an array expression on the report row; ``parse_findings`` picks the
first tier that recognises the report's shape (even when it yields nothing) and
explodes that array.  There is no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.json_values import is_array, is_object, string_field, with_json
from ..functions.severity import at_or_above, normalize_severity, severity_rank, top_severity
from ..functions.text import byte_prefix, let, trimmed
from ..session import kept

ITEM = (
    "array<struct<severity:string,title:string,function:string,description:string,body:string>>"
)


def _item(severity, title, function, description, body) -> Column:
    def text(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        severity.alias("severity"),
        text(title).alias("title"),
        text(function).alias("function"),
        text(description).alias("description"),
        text(body).alias("body"),
    )


# ---- tiers as array expressions ------------------------------------------------


def marker_items(report: Column) -> Column:
    """``>>> SEVERITY: title | rest`` lines."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(report, F.lit(fixed.MARKER), 1).alias("s"),
        F.regexp_extract_all(report, F.lit(fixed.MARKER), 2).alias("t"),
    )
    return F.transform(
        pairs,
        lambda p: _item(
            normalize_severity(p["s"]),
            trimmed(F.split_part(p["t"], F.lit("|"), F.lit(1))),
            "",
            "",
            trimmed(p["t"]),
        ),
    )


def json_values(value: Column) -> Column:
    """Values to read items from, or null when the shape is not recognised."""
    members = F.try_variant_get(value, "$.findings", "variant")
    single = F.try_variant_get(value, "$.severity", "variant").isNotNull()
    elements = F.try_variant_get(value, "$", "array<variant>")
    listed = F.try_variant_get(value, "$.findings", "array<variant>")
    return (
        F.when(is_array(value), elements)
        .when(is_object(value) & single, F.array(value))
        .when(is_object(value) & is_array(members), listed)
    )


def json_items(values: Column) -> Column:
    """Finding items of decoded values; non-objects and ``clean`` are dropped."""
    objects = F.filter(values, is_object)

    def read(value: Column) -> Column:
        description = F.coalesce(string_field(value, "description"), F.lit(""))
        fix = string_field(value, "fix")
        full = F.when(fix.isNotNull(), F.concat(description, F.lit("\n\nFix: "), fix)).otherwise(
            description
        )
        return _item(
            normalize_severity(F.coalesce(string_field(value, "severity"), F.lit("medium"))),
            F.coalesce(string_field(value, "title"), F.lit(fixed.UNTITLED)),
            F.coalesce(string_field(value, "function"), F.lit("")),
            full,
            full,
        )

    return F.filter(F.transform(objects, read), lambda x: x["severity"] != fixed.CLEAN)


def _first_severity_word(text: Column) -> Column:
    return F.regexp_extract(text, fixed.SEVERITY_WORD, 1)


def heading_items(report: Column) -> Column:
    """Sections under headings that name a bug."""
    line_not_heading = r"(?:\n(?!#{1,4}" + fixed.WS + r"+.)[^\n]*+)*+"
    sections = F.regexp_extract_all(report, F.lit(fixed.HEADING + line_not_heading), 0)

    def titled(section: Column) -> Column:
        title = trimmed(F.regexp_extract(section, fixed.HEADING, 1))
        title = F.btrim(title, F.lit("* "))
        title = F.regexp_replace(title, fixed.TITLE_PREFIX_SEVERITY, "")
        title = trimmed(F.regexp_replace(title, fixed.TITLE_PREFIX_LEVEL, ""))
        return F.struct(title.alias("title"), trimmed(section).alias("body"))

    def stays(x: Column) -> Column:
        title, body = x["title"], x["body"]
        named = title.rlike(fixed.BUG_KEYWORD) | byte_prefix(
            body, fixed.MAX_KEYWORD_BYTES
        ).rlike(fixed.BUG_KEYWORD)
        junk = title.rlike(fixed.JUNK_TITLE) | title.rlike(fixed.SIGNATURE_TITLE)
        return (title != "") & ~junk & named

    def read(x: Column) -> Column:
        # a section without a severity word gives "", which normalises to medium
        severity = let(_first_severity_word(x["body"]), normalize_severity)
        return _item(severity, x["title"], "", "", x["body"])

    return F.transform(F.filter(F.transform(sections, titled), stays), read)


def unstructured_items(report: Column) -> Column:
    words = F.filter(F.array(_first_severity_word(report)), lambda w: w != "")
    return F.transform(
        words, lambda w: _item(normalize_severity(w), fixed.UNSTRUCTURED, "", "", trimmed(report))
    )


# ---- operators -----------------------------------------------------------------


def _explode(df: DataFrame, items: Column, keys: list[str]) -> DataFrame:
    # exploding a bare column makes the optimizer derive a filter from it and copy the whole
    # extraction into that filter; an expression over the column is evaluated once
    once = F.filter(items.cast(ITEM), lambda x: x.isNotNull())
    return df.select(*keys, F.posexplode(once).alias("pos", "item")).select(
        *keys, "pos", "item.*"
    )


def marker_findings(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    return _explode(reports, marker_items(F.col(report)), keys)


def json_findings(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """Items of the JSON tier read from the text as it is (no repair)."""
    decoded = with_json(reports, report)
    values = F.when(F.col("json_from") == "whole", json_values(F.col("json")))
    return _explode(decoded, json_items(values), keys)


def json_salvage(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """Texts that do not decode as they are: which repair worked and what it gave."""
    decoded = with_json(reports, report)
    items = F.coalesce(json_items(json_values(F.col("json"))), F.expr(f"cast(array() as {ITEM})"))
    found = F.struct(
        F.col("json_from").alias("method"), F.col("json_text"), F.size(items).alias("n_items")
    )
    repaired = F.col("json_from").isin("numbered", "objects", "array", "object")
    # exploding one or no row instead of filtering keeps the extraction in one place
    return decoded.select(*keys, F.explode(F.when(repaired, F.array(found))).alias("f")).select(
        *keys, "f.*"
    )


def heading_findings(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    return _explode(reports, heading_items(F.col(report)), keys)


def unstructured_findings(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    return _explode(reports, unstructured_items(F.col(report)), keys)


def with_tier(reports: DataFrame, report: str = "report") -> DataFrame:
    """Add ``tier`` and its ``items`` to each report."""
    text = F.col(report)
    marked = F.col("_marked")
    df = with_json(reports.withColumn("_marked", text.rlike(fixed.MARKER)), report, when=~marked)
    df = df.withColumn("_values", F.when(~marked, json_values(F.col("json"))))
    df = df.withColumn(
        "_headed", F.when(~marked & F.col("_values").isNull(), heading_items(text).cast(ITEM))
    )
    items = (
        F.when(F.col("_marked"), marker_items(text).cast(ITEM))
        .when(F.col("_values").isNotNull(), json_items(F.col("_values")).cast(ITEM))
        .when(F.size("_headed") > 0, F.col("_headed"))
        .otherwise(unstructured_items(text).cast(ITEM))
    )
    df = df.withColumn("items", items)
    tier = (
        F.when(F.col("_marked"), "marker")
        .when(F.col("_values").isNotNull(), "json")
        .when(F.size("_headed") > 0, "heading")
        .when(F.size("items") > 0, "unstructured")
        .otherwise("none")
    )
    return df.withColumn("tier", tier).drop(
        "json", "json_from", "json_text", "_values", "_headed", "_marked"
    )


def parse_findings(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """One row per finding: keys, tier, pos, severity, title, function, description, body."""
    return _explode(with_tier(reports, report), F.col("items"), [*keys, "tier"])


def _counts() -> list[Column]:
    def count(name: str) -> Column:
        return F.size(F.filter("items", lambda x: x["severity"] == name)).alias(name)

    return [count(name) for name in fixed.SEVERITIES]


def severity_counts(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """Five counts per report, zeros kept; counted inside the row, so no shuffle."""
    return with_tier(reports, report).select(*keys, *_counts())


def parse_and_count(reports: DataFrame, keys: list[str], more: list[str], report: str = "report") -> tuple[DataFrame, DataFrame]:
    """``severity_counts`` by keys and ``more``, and ``parse_findings`` by keys, of one parse of the reports.

    It is stored as one row a finding, and one for a report without any.
    """
    items = F.filter(F.col("items").cast(ITEM), lambda x: x.isNotNull())
    counted = with_tier(reports, report).select(*keys, *more, *_counts(), "tier", "items")
    rows = counted.select(*counted.columns[:-1], F.posexplode_outer(items).alias("pos", "item"))
    stored = kept(rows.select(*rows.columns[:-1], "item.*"))
    fields = [f.name for f in rows.schema["item"].dataType]
    return (
        stored.filter(F.coalesce("pos", F.lit(0)) == 0).select(*keys, *more, *fixed.SEVERITIES),
        stored.filter(F.col("pos").isNotNull()).select(*keys, "tier", "pos", *fields),
    )


def with_top_severity(counts: DataFrame) -> DataFrame:
    cols = {name: F.col(name) for name in fixed.SEVERITIES}
    return counts.withColumn("top_severity", top_severity(cols))


def severity_threshold(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).filter(
        at_or_above(F.col("severity"), threshold)
    )
