"""First JSON value inside free-form text, as VARIANT, with three repairs.

``with_json`` adds the decoded value of a text column.  Order of attempts:

1. the first fenced block, or else the whole text, as it is;
2. when it mentions ``"severity"``: numbered objects rewritten to an array and
   bad backslashes doubled; failing that, every object that starts with it;
3. the first balanced ``[…]``, then the first balanced ``{…}``.

Everything is native except cutting balanced chunks, which one Arrow UDF does
for the rows where 1 and the rewrite of 2 failed; other rows pass it a null.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .text import trimmed

# a scalar that decodes on its own stops the search without giving rows
_SCALAR = (
    r"\A(?:true|false|null"
    r'|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
    r"|-?(?:0|[1-9][0-9]*+)(?:(?![.eE])|\.[0-9]++(?:(?![eE])|[eE][+-]?[0-9]+)|[eE][+-]?[0-9]+))"
)


def candidate(text: Column) -> Column:
    body = trimmed(text)
    blocks = F.regexp_extract_all(body, F.lit(fixed.FENCE), 1)
    return F.when(body.rlike(fixed.FENCE), trimmed(F.get(blocks, F.lit(0)))).otherwise(body)


def double_bad_backslashes(text: Column) -> Column:
    return F.regexp_replace(text, fixed.BAD_BACKSLASH, r"\\\\$1")


def numbered_to_array(text: Column) -> Column:
    """``1: {…}, 2: {…}`` becomes an array; bad backslashes are doubled."""
    body = trimmed(F.regexp_replace(text, fixed.NUMBERED_OBJECT, ", {"))
    body = F.when(F.startswith(body, F.lit("[,")), F.substring(body, F.lit(3), F.length(body))).otherwise(body)
    body = trimmed(body)
    needs = ~F.startswith(body, F.lit("[")) & F.contains(body, F.lit("{"))
    return double_bad_backslashes(F.when(needs, F.concat(F.lit("["), body)).otherwise(body))


def _severity_objects(text: str) -> list[str]:
    """Every object opening with the severity key, to its matching brace."""
    starts = {m.start() for m in re.finditer(fixed.SEVERITY_OBJECT, text)}
    if not starts:
        return []
    open_at: list[int] = []
    spans = []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            open_at.append(m.start())
        elif open_at:
            start = open_at.pop()
            if start in starts:
                spans.append((start, m.end()))
    return [text[a:b] for a, b in sorted(spans)]


def _balanced(text: str, opening: str, closing: str) -> str | None:
    """First balanced chunk; brackets inside strings do not count."""
    start = text.find(opening)
    if start < 0:
        return None
    depth = 0
    quoted = False
    step = re.compile(r"\\.|[\"%s]" % re.escape(opening + closing), re.S)
    at = start
    while True:
        m = step.search(text, at)
        if m is None:
            return None
        token, at = m.group(), m.end()
        if token[0] == "\\" and not quoted:
            at = m.start() + 1  # outside strings a backslash escapes nothing
        elif token == '"':
            quoted = not quoted
        elif not quoted and token == opening:
            depth += 1
        elif not quoted and token == closing:
            depth -= 1
            if depth == 0:
                return text[start:at]


_CHUNKS = T.StructType(
    [
        T.StructField("objects", T.ArrayType(T.StringType())),
        T.StructField("array", T.StringType()),
        T.StructField("object", T.StringType()),
    ]
)


@F.pandas_udf(_CHUNKS)
def balanced_chunks(texts: pd.Series) -> pd.DataFrame:
    rows = [
        (None, None, None)
        if t is None
        else (
            _severity_objects(t) if '"severity"' in t else [],
            _balanced(t, "[", "]"),
            _balanced(t, "{", "}"),
        )
        for t in texts
    ]
    return pd.DataFrame(rows, columns=["objects", "array", "object"])


def with_json(df: DataFrame, text: str, when: Column | None = None) -> DataFrame:
    """Add ``json`` (VARIANT or null) and ``json_from`` (how it was found).

    ``when`` limits the work to the rows that need it; the others get nulls.
    """
    body = candidate(F.col(text))
    df = df.withColumn("_body", body if when is None else F.when(when, body))
    # only [ and { can open a value that gives rows; other scalars end the search
    df = df.withColumn("_scalar", F.col("_body").rlike(_SCALAR))
    opens = F.substring(F.col("_body"), 1, 1).isin("[", "{")
    df = df.withColumn("_whole", F.when(opens, F.try_parse_json("_body")))
    undecoded = F.col("_whole").isNull() & ~F.col("_scalar")
    listed = F.contains(F.col("_body"), F.lit('"severity"'))
    df = df.withColumn(
        "_numbered_text", F.when(undecoded & listed, numbered_to_array(F.col("_body")))
    ).withColumn("_numbered", F.try_parse_json("_numbered_text"))
    # without a bracket there is nothing to cut
    open_left = F.contains("_body", F.lit("[")) | F.contains("_body", F.lit("{"))
    cut = undecoded & F.col("_numbered").isNull() & open_left
    df = df.withColumn("_chunks", balanced_chunks(F.when(cut, F.col("_body"))))
    objects = F.filter(
        F.transform(F.col("_chunks.objects"), double_bad_backslashes),
        lambda x: F.try_parse_json(x).isNotNull(),
    )
    df = df.withColumn("_objects", objects)
    df = df.withColumn("_array", F.try_parse_json(F.col("_chunks.array")))
    df = df.withColumn(
        "_object", F.when(F.col("_array").isNull(), F.try_parse_json(F.col("_chunks.object")))
    )
    source = (
        F.when(F.col("_whole").isNotNull(), F.lit("whole"))
        .when(F.col("_scalar"), F.lit("scalar"))
        .when(F.col("_numbered").isNotNull(), F.lit("numbered"))
        .when(F.size("_objects") > 0, F.lit("objects"))
        .when(F.col("_array").isNotNull(), F.lit("array"))
        .when(F.col("_object").isNotNull(), F.lit("object"))
    )
    df = df.withColumn("json_from", source).withColumn(
        "json_text",
        F.when(F.col("json_from") == "numbered", F.col("_numbered_text"))
        .when(F.col("json_from") == "objects", F.array_join("_objects", "\n"))
        .when(F.col("json_from") == "array", F.col("_chunks.array"))
        .when(F.col("json_from") == "object", F.col("_chunks.object"))
        .when(F.col("json_from") == "whole", F.col("_body")),
    )
    value = F.coalesce(
        F.col("_whole"),
        F.col("_numbered"),
        F.when(
            F.col("json_from") == "objects",
            F.transform("_objects", F.try_parse_json).cast("variant"),
        ),
        F.col("_array"),
        F.col("_object"),
    )
    return df.withColumn("json", value).drop(
        "_body", "_scalar", "_whole", "_numbered_text", "_numbered", "_chunks", "_objects",
        "_array", "_object",
    )


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.lit(False))


def string_field(value: Column, key: str) -> Column:
    """A field's text as it is; null when missing, not a string, or blank."""
    field = F.try_variant_get(value, f"$.{key}", "variant")
    text = F.try_variant_get(value, f"$.{key}", "string")
    return F.when((F.schema_of_variant(field) == "STRING") & (trimmed(text) != ""), text)
