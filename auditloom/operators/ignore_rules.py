"""Ignore rules as data: which paths of a run the rule files in its folders leave out.

``rules`` has (run_id, folder, line, rule), one row a line of a rule file in ``folder``
(relative to the run's tree, empty for its top).  A rule without a slash before its end
matches at any depth below its folder, other rules from the folder on; ``*``, ``?`` and
``[…]`` do not cross slashes, ``**`` does; a slash at the end asks for a directory; ``!`` takes
back; the last rule that matches decides, deeper folders after higher ones.  What lies in
an ignored directory is ignored, whatever is said about it below.

Every directory is judged once, not once a file, and a path meets only those rules of its own
ancestors whose plain letters its name begins or ends with; a rule that stands again
further down is met once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, fitting

#: Stand-ins while a rule is rewritten; no path holds them.
_STAR, _MARK, _OPEN, _DEEP, _TAIL = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
#: Plain letters of a rule that are compared before its expression.
KEY_CHARS = 3


def rule_pattern(rule: Column) -> Column:
    """A rule's body (no ``!``, no slash at the end) as an expression over relative paths."""
    anchored = F.contains(rule, F.lit("/"))
    body = F.regexp_replace(rule, "^/", "")
    for sign, held in ((r"\\\*", _STAR), (r"\\\?", _MARK), (r"\\\[", _OPEN)):
        body = F.regexp_replace(body, sign, held)
    body = F.regexp_replace(body, r"\\(.)", "$1")
    body = F.regexp_replace(body, r"([.+^$(){}|\\])", r"\\$1")
    body = F.regexp_replace(body, r"\[!", "[^")
    body = F.regexp_replace(body, r"(?<![^/])\*\*/", _DEEP)
    body = F.regexp_replace(body, r"/\*\*$", _TAIL)
    body = F.regexp_replace(body, r"\*+", "[^/]*")
    body = F.regexp_replace(body, r"\?", "[^/]")
    for held, text in ((_DEEP, "(?:.*/)?"), (_TAIL, "/.+"), (_STAR, r"\*"), (_MARK, r"\?"), (_OPEN, r"\[")):
        body = F.replace(body, F.lit(held), F.lit(text))
    return F.concat(F.lit("(?s)^"), F.when(anchored, "").otherwise("(?:.*/)?"), body, F.lit("$"))


def parsed_rules(rules: DataFrame) -> DataFrame:
    """(run_id, folder, line, taken_back, only_dirs, pattern, key) of lines that are rules."""
    text = F.regexp_replace("rule", r"(?<!\\)[ \t\r]+$", "")
    kept = rules.select("run_id", F.btrim("folder", F.lit("/")).alias("folder"), "line", text.alias("text"))
    bare = F.regexp_replace("text", "^!", "")
    return kept.filter(~F.col("text").rlike("^(#|$)")).select(
        "run_id",
        "folder",
        "line",
        F.startswith("text", F.lit("!")).alias("taken_back"),
        F.endswith(bare, F.lit("/")).alias("only_dirs"),
        rule_pattern(F.regexp_replace(bare, "/$", "")).alias("pattern"),
        rule_key(F.regexp_replace(bare, "/$", "")).alias("key"),
    )


def rule_key(rule: Column) -> Column:
    """What a rule says of a name in plain letters, one of the name's ``name_keys``: its end, else its start."""
    tail = F.regexp_extract(rule, r"([^/]*)\z", 1)
    # nothing is said of names by escapes, by ** and by a class that holds a slash
    plain = ~F.contains(rule, F.lit("\\")) & ~F.contains(tail, F.lit("**")) & ~tail.rlike(r"^[^\[]*\]")
    end = F.right(F.regexp_extract(tail, r"([^*?\[\]]*)\z", 1), F.lit(KEY_CHARS))
    start = F.left(F.regexp_extract(tail, r"^([^*?\[\]]*)", 1), F.lit(KEY_CHARS))
    return F.when(plain & (end != ""), F.concat(F.lit("e"), end)).when(plain & (start != ""), F.concat(F.lit("s"), start)).otherwise("")


def name_keys(name: Column) -> Column:
    sizes = range(1, KEY_CHARS + 1)
    ends = [F.concat(F.lit("e"), F.right(name, F.lit(k))) for k in sizes]
    starts = [F.concat(F.lit("s"), F.left(name, F.lit(k))) for k in sizes]
    return F.array_distinct(F.array(F.lit(""), *ends, *starts))


def standing(rules: DataFrame) -> DataFrame:
    """Of rules that match the same, the last one, which overrides the others."""
    same = ["run_id", "folder", "only_dirs", "pattern", "key"]
    return rules.groupBy(*same).agg(
        F.max("line").alias("line"), F.max_by("taken_back", F.struct("line")).alias("taken_back")
    )


def _heads(path: Column) -> Column:
    """The ancestors of a path below the top, itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored_by_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(run_id, path) of the paths (relative files) that the rules leave out."""
    known = fitting(durable(standing(parsed_rules(rules))))
    steps = durable(paths.select("run_id", "path").distinct()).select(
        "run_id", "path", F.posexplode(_heads(F.col("path"))).alias("_k", "head")
    )
    heads = steps.select("run_id", "head", (F.col("head") != F.col("path")).alias("is_dir")).distinct()
    folders = F.concat(F.array(F.lit("")), F.filter(_heads(F.col("head")), lambda x: x != F.col("head")))
    asked = heads.select("run_id", "head", "is_dir", F.explode(folders).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("head")).otherwise(
        F.substring("head", F.length("folder") + 2, F.length("head"))
    )
    name = F.regexp_extract("head", r"([^/]*)\z", 1)
    keyed = asked.select("*", F.explode(name_keys(name)).alias("key"))
    told = keyed.join(known, ["run_id", "folder", "key"]).filter(
        (F.col("is_dir") | ~F.col("only_dirs")) & F.regexp_like(below, F.col("pattern"))
    )
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    judged = told.groupBy("run_id", "head", "is_dir").agg(
        F.max_by("taken_back", F.struct(depth, "line")).alias("taken_back")
    )
    closed = judged.filter(~F.col("taken_back")).select("run_id", "head", "is_dir")
    return (
        steps.withColumn("is_dir", F.col("head") != F.col("path"))
        .join(closed, ["run_id", "head", "is_dir"], "left_semi")
        .select("run_id", "path")
        .distinct()
    )
