"""Triage: several rounds of verdicts per finding become one decision.

A finding has at most ``rounds`` + 1 rows (the rounds setting and one arbiter),
so per-finding collections are bounded by that setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.json_values import is_object, string_field, with_json
from ..functions.severity import at_or_above, one_of, verdict_letter
from ..functions.text import byte_prefix, half_up, trimmed
from .evidence import condense_evidence
from .ranking import numbered

FINDING = ["run_id", "finding_id"]


def triage_candidates(
    findings: DataFrame,
    scan_results: DataFrame,
    threshold: str = "medium",
    mode: str = "enabled",
) -> DataFrame:
    """Findings of ``ok`` files at or above the threshold; none when triage is off."""
    if one_of(mode, ("enabled", "disabled"), "triage mode") == "disabled":
        return findings.limit(0)
    ok = scan_results.filter(F.col("status") == "ok").select("run_id", "file_id")
    return findings.filter(at_or_above(F.col("severity"), threshold)).join(
        ok, ["run_id", "file_id"], "left_semi"
    )


def finding_json(findings: DataFrame) -> Column:
    """A finding as compact JSON; empty fields are left out, HTML characters escaped."""
    names = [n for n in ("severity", "title", "function", "file") if n in findings.columns]
    always = ("severity", "title")
    fields = [
        (F.col(n) if n in always else F.when(F.col(n) != "", F.col(n))).alias(n) for n in names
    ]
    out = F.to_json(F.struct(*fields))
    for raw, code in fixed.JSON_HTML.items():
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def finding_text(findings: DataFrame) -> Column:
    """Heading and body; without a body the description, else the finding as JSON."""
    body = F.coalesce(
        F.when(F.col("body") != "", F.col("body")),
        F.when(F.col("description") != "", F.col("description"))
        if "description" in findings.columns
        else F.lit(None),
        finding_json(findings),
    )
    return F.format_string(fixed.FINDING_TEXT, F.upper("severity"), F.col("title"), body)


#: Stands before the earlier reviews where the caller gives no text of their own.
EARLIER = "\n\nEarlier reviews:\n\n"


def round_prompts(
    findings: DataFrame, rounds: DataFrame, template: str, project: str, earlier: str = EARLIER
) -> DataFrame:
    """The prompt of every round: finding, code, context and all earlier reviews.

    ``findings``: run_id, finding_id, file, severity, title, body, code, context, and
    if known description and function.
    ``rounds``: run_id, finding_id, round_no, reasoning, evidence.
    ``template`` takes project, finding, file and code, in this order; ``earlier`` stands
    before the earlier reviews.
    """
    full = F.when(
        F.coalesce("evidence", F.lit("")) != "",
        F.concat("reasoning", F.lit(fixed.EVIDENCE_HEADING), "evidence"),
    ).otherwise(F.col("reasoning"))
    reviews = rounds.select(*FINDING, "round_no", full.alias("full")).withColumn(
        "short", condense_evidence(F.col("full"))
    )
    before = (
        Window.partitionBy(*FINDING)
        .orderBy("round_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    prior = reviews.withColumn("prior", F.collect_list(F.struct("full", "short")).over(before))
    listed = F.transform(
        "prior",
        lambda r, i: F.format_string(
            fixed.REVIEW_PART,
            i + 1,
            F.when(i < F.size("prior") - 1, r["short"]).otherwise(r["full"]),
        ),
    )
    context = F.coalesce("context", F.lit(""))
    prompt = F.concat(
        F.format_string(
            template,
            F.lit(project),
            finding_text(findings),
            F.col("file"),
            F.coalesce("code", F.lit("")),
        ),
        F.when(
            context != "",
            F.format_string(fixed.CONTEXT_PART, byte_prefix(context, fixed.MAX_CONTEXT_BYTES)),
        ).otherwise(""),
        F.when(
            F.size("prior") > 0,
            F.concat(F.lit(earlier), F.array_join(listed, "")),
        ).otherwise(""),
    )
    return (
        prior.drop("full", "short")
        .join(findings, FINDING)
        .select(*FINDING, "round_no", F.size("prior").alias("n_prior"), prompt.alias("prompt"))
    )


def parse_verdicts(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Response text → verdict and reasoning.  ``error`` is non-null for failed calls.

    Where the responses have them, a round also carries its tokens and elapsed seconds.
    """
    failed = F.col("error").isNotNull()
    df = with_json(responses, "content", when=~failed)
    df = df.withColumn("_object", is_object(F.col("json")))

    def field(name: str) -> Column:
        return string_field(F.col("json"), name)

    word = F.upper(field("verdict"))
    listed = F.when(word.isin(*fixed.VERDICTS[:3]), word).otherwise("UNCERTAIN")
    text = F.upper(trimmed(F.col("content")))
    spoken = (
        F.when(F.startswith(text, F.lit("INVALID")), "INVALID")
        .when(F.startswith(text, F.lit("VALID")), "VALID")
        .otherwise("UNCERTAIN")
    )
    request = field("grep")
    request = F.when(
        F.startswith(request, F.lit("GREP:")), F.substring(request, F.lit(6), F.length(request))
    ).otherwise(request)
    request = F.btrim(request, F.lit(fixed.QUOTES + " "))
    crux = field("crux")
    reasoning = F.concat(
        F.coalesce(field("reasoning"), F.col("content")),
        F.when(crux.isNotNull(), F.concat(F.lit("\n\nCRUX: "), crux)).otherwise(""),
        F.when(request != "", F.concat(F.lit("\nGREP: "), request)).otherwise(""),
    )
    return df.select(
        *keys,
        F.when(failed, "ERROR").when(F.col("_object"), listed).otherwise(spoken).alias("verdict"),
        F.when(failed, F.col("error"))
        .when(F.col("_object"), reasoning)
        .otherwise(F.col("content"))
        .alias("reasoning"),
        *([F.col("total_tokens").alias("tokens")] if "total_tokens" in df.columns else []),
        *([half_up(F.col("elapsed_s"), 10).alias("elapsed_s")] if "elapsed_s" in df.columns else []),
    )


def round_evidence(rounds: DataFrame, evidence: DataFrame) -> DataFrame:
    """Attach evidence to rounds; ``grep_used`` tells whether there is any."""
    return rounds.join(
        evidence.select(*FINDING, "round_no", "evidence"), [*FINDING, "round_no"], "left"
    ).withColumn("grep_used", F.col("evidence").isNotNull())


def _valid_share() -> Column:
    share = F.count_if(F.col("verdict") == "VALID").cast("double") / F.count(F.lit(1))
    return half_up(share, 100)


def confidence(rounds: DataFrame) -> DataFrame:
    """Valid rounds over all rounds; uncertain and failed rounds count below."""
    return rounds.groupBy(*FINDING).agg(
        F.count(F.lit(1)).alias("n_rounds"), _valid_share().alias("confidence")
    )


def _letters() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("round_no", verdict_letter(F.col("verdict")).alias("c"))))
    return F.array_join(ordered["c"], "")


def verdict_string(rounds: DataFrame) -> DataFrame:
    """First letters in round order."""
    return rounds.groupBy(*FINDING).agg(_letters().alias("verdicts"))


def arbiter_requests(
    findings: DataFrame, rounds: DataFrame, template: str, project: str
) -> DataFrame:
    """The arbiter's prompt over all rounds of a finding (rounds setting above one).

    ``template`` takes project, title, finding, evidence, verdict letters, valid and
    invalid counts, file and code, in this order.
    """
    extract = F.concat(
        F.format_string(
            fixed.ROUND_EXTRACT,
            "round_no",
            "verdict",
            byte_prefix(F.col("reasoning"), fixed.MAX_EXTRACT_BYTES),
        ),
        F.when(
            F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit("\n"), "evidence")
        ).otherwise(""),
    )
    summed = rounds.groupBy(*FINDING).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("round_no", extract.alias("e"))))["e"], "\n"
        ).alias("key_evidence"),
        _letters().alias("verdicts"),
        F.count_if(F.col("verdict") == "VALID").alias("valid"),
        F.count_if(F.col("verdict") == "INVALID").alias("invalid"),
        F.count(F.lit(1)).alias("n_rounds"),
    )
    prompt = F.format_string(
        template,
        F.lit(project),
        F.col("title"),
        finding_text(findings),
        F.col("key_evidence"),
        F.col("verdicts"),
        F.col("valid"),
        F.col("invalid"),
        F.col("file"),
        F.coalesce("code", F.lit("")),
    )
    return (
        summed.filter(F.col("n_rounds") > 1)
        .join(findings, FINDING)
        .select(*FINDING, "verdicts", "valid", "invalid", prompt.alias("prompt"))
    )


def final_verdict(findings: DataFrame, rounds: DataFrame, arbiter: DataFrame) -> DataFrame:
    """Decision per finding.

    The arbiter's round is accepted only when it says VALID or INVALID, and then
    counts in the confidence too.  The last accepted round decides, whatever it says.
    """
    accepted = arbiter.filter(F.col("verdict").isin("VALID", "INVALID"))
    cols = [*FINDING, "round_no", "verdict", "reasoning"]
    every = rounds.select(*cols, F.lit(False).alias("is_arbiter")).unionByName(
        accepted.select(*cols, F.lit(True).alias("is_arbiter"))
    )
    letter = F.concat(
        F.when(F.col("is_arbiter"), "->").otherwise(""), verdict_letter(F.col("verdict"))
    )
    decided = every.groupBy(*FINDING).agg(
        F.max_by(F.struct("verdict", "reasoning"), "round_no").alias("last"),
        _valid_share().alias("confidence"),
        F.array_join(
            F.array_sort(F.collect_list(F.struct("round_no", letter.alias("c"))))["c"], ""
        ).alias("verdicts"),
        F.count(F.lit(1)).alias("n_rounds"),
    )
    return decided.join(findings, FINDING).select(
        *FINDING,
        "file",
        "title",
        "severity",
        F.col("last.verdict").alias("verdict"),
        F.col("last.reasoning").alias("reasoning"),
        "confidence",
        "verdicts",
        "n_rounds",
    )


def triage_order(triage: DataFrame) -> DataFrame:
    """Position per run: VALID first, then confidence, then file."""
    return numbered(
        triage,
        ["run_id"],
        [
            F.when(F.col("verdict") == "VALID", 0).otherwise(1),
            (F.col("confidence"), True),
            F.col("file"),
            F.col("finding_id"),
        ],
        "position",
        FINDING,
    )


def verdict_tally(runs: DataFrame, triage: DataFrame) -> DataFrame:
    """Four counts per run, zeros kept."""
    names = [v.lower() for v in fixed.VERDICTS]
    counts = triage.groupBy("run_id").agg(
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in fixed.VERDICTS]
    )
    zero = F.lit(0).cast("long")
    return runs.join(counts, "run_id", "left").select(
        "run_id", *[F.coalesce(F.col(n), zero).alias(n) for n in names]
    )
