"""Prompt tables out, reply tables in: the offline side of model batches.

No network: ``prompt_*`` build the rows to send, ``merge_*`` take (violation_id, content,
error) rows back.  A reply that cannot be read affects its own row only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import (
    CHARS_PER_TOKEN, CLASSIFY_PROMPT, FALLBACK_PRICES, FIX_MODEL, FIX_PROMPT,
    MAX_TOKENS_PER_REQUEST, MODEL_PRICES, PR_DESCRIPTION_PROMPT, REVIEW_MODEL, REVIEW_PROMPT,
    SCAN_MODEL, SYSTEM_MESSAGE, VALIDATION_PASSED,
)
from ..functions.secrets import mask_secrets, unsafe_issues
from ..functions.text import code_hash, strip, violation_id
from .folding import MAX_TEXT_BYTES, fold_texts


def _with_id(violations: DataFrame) -> DataFrame:
    if "violation_id" in violations.columns:
        return violations
    return violations.withColumn("violation_id", violation_id(
        F.col("file_path"), F.col("line_number"), F.col("violation_type")))


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """The template with {name} replaced; filled-in text is never searched again."""
    pieces, rest = [], template
    while True:
        at = {name: rest.find("{" + name + "}") for name in fields}
        at = {name: pos for name, pos in at.items() if pos >= 0}
        if not at:
            pieces.append(F.lit(rest))
            return F.concat(*pieces)
        name = min(at, key=at.get)
        pieces += [F.lit(rest[:at[name]]), fields[name]]
        rest = rest[at[name] + len(name) + 2:]


def _context() -> Column:
    """Lines before, the line and lines after; not masked."""
    return F.array_join(F.concat(
        "context_before", F.array("line_content"), "context_after"), "\n")


def _rows(df: DataFrame, kind: str, model: str, prompt: Column) -> DataFrame:
    return (
        df.select("violation_id", F.lit(kind).alias("kind"), F.lit(model).alias("model"),
                  F.lit(SYSTEM_MESSAGE).alias("system"), prompt.alias("prompt"))
        .withColumn("input_hash", code_hash(F.col("prompt")))
    )


def _common() -> dict[str, Column]:
    return {name: F.col(name) for name in ("violation_type", "platform", "language")}


def prompt_classify(violations: DataFrame, model: str = SCAN_MODEL) -> DataFrame:
    return _rows(_with_id(violations), "classify", model, fill_template(CLASSIFY_PROMPT, {
        **_common(), "snippet": mask_secrets(F.col("line_content")), "context": _context()}))


def prompt_fix(violations: DataFrame, model: str = FIX_MODEL) -> DataFrame:
    return _rows(_with_id(violations), "fix", model, fill_template(FIX_PROMPT, {
        **_common(), "snippet": mask_secrets(F.col("line_content")), "context": _context()}))


def prompt_review(fixes: DataFrame, model: str = REVIEW_MODEL) -> DataFrame:
    """Only for fixes that are not empty."""
    return _rows(fixes.where("fixed_code <> ''"), "review", model, fill_template(REVIEW_PROMPT, {
        **_common(), "original_code": F.col("original_code"), "fixed_code": F.col("fixed_code")}))


def prompt_pr_description(fixes: DataFrame, *keys: str, max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """(keys, part, parts, prompt): one prompt per group of fixes.

    A summary of more than ``max_bytes`` bytes is told in several numbered prompts; without keys it
    raises.
    """
    row = F.concat(F.lit("- "), F.col("violation_type"), F.lit(" "), F.col("file_path"), F.lit(":"),
                   F.col("line_number").cast("string"), F.lit(" "), F.col("explanation"), F.lit("\n"))
    summaries = fold_texts(fixes.where(row.isNotNull()), *keys, order=F.struct("file_path", "detector_ord", "emit_ord"),
                           text=row, max_bytes=max_bytes)
    groups = fixes.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("string").alias("total_count"),
        F.array_join(F.sort_array(F.collect_set("violation_type")), ", ").alias("categories")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "total_count", "categories")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return groups.join(summaries, same).select(*keys, "part", "parts", fill_template(PR_DESCRIPTION_PROMPT, {
        "fixes_summary": F.regexp_replace("text", "\n\\z", ""), "total_count": F.col("total_count"),
        "categories": F.col("categories")}).alias("prompt"))


def cost_estimate(prompts: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds the estimated cost in USD; unknown models use the fallback prices."""
    # a fixed literal table with one row per model
    prices = F.broadcast(spark.createDataFrame(
        list(MODEL_PRICES), "model string, input_price double, output_price double"))
    return (
        prompts.join(prices, "model", "left")
        .withColumn("cost", F.length("prompt") / CHARS_PER_TOKEN / 1_000_000
                    * F.coalesce("input_price", F.lit(FALLBACK_PRICES[0]))
                    + F.lit(MAX_TOKENS_PER_REQUEST) / 1_000_000
                    * F.coalesce("output_price", F.lit(FALLBACK_PRICES[1])))
        .drop("input_price", "output_price")
    )


# --- replies -------------------------------------------------------------------


def parse_json(content: Column) -> Column:
    """JSON text of a reply: the whole, a fenced block, or the outermost braces; else null.

    The first candidate that is strict JSON wins.
    """
    text = strip(content)
    candidates = [text] + [
        strip(F.regexp_extract(text, "(?sUd)" + pattern, group))
        for pattern, group in ((r"```json\s*\n(.*?)```", 1), (r"```\s*\n(.*?)```", 1), (r"\{.*\}", 0))
    ]
    strict = [F.when(c != "", F.try_parse_json(c)) for c in candidates]
    return F.to_json(F.coalesce(*strict))


def one_reply(replies: DataFrame, kind: str) -> DataFrame:
    """The replies of a kind, one for each id: of several, those without error first, then by text."""
    order = Window.partitionBy("violation_id").orderBy(
        F.coalesce(F.col("error"), F.lit("")) != "", F.col("content").asc_nulls_last(), "error")
    return replies.where(F.col("kind") == kind).withColumn("turn", F.row_number().over(order)).where(
        "turn = 1").drop("turn")


def parsed_replies(replies: DataFrame, schema: str) -> DataFrame:
    """Adds ``r`` (struct, null unless the reply is a JSON object) and ``parse_error``."""
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    json = F.col("json")
    is_object = F.coalesce(json.startswith("{"), F.lit(False))
    # exploding a one-element array keeps filters on the result from being pushed into, and
    # with them copies of, the parsing steps: each reply is parsed once
    once = replies.select("*", F.explode(F.array(F.when(no_error, parse_json(F.col("content"))))).alias("json"))
    parsed = once.select("*", F.explode(F.array(F.when(
        is_object, F.from_json("json", schema, {"allowSingleQuotes": "false"})))).alias("r"))
    return parsed.withColumn("parse_error", F.when(~no_error, F.col("error"))
                             .when(json.isNull(), F.lit("No valid JSON found in response"))
                             .when(~is_object, F.lit("Reply is not a JSON object")))


def merge_classification(violations: DataFrame, replies: DataFrame) -> DataFrame:
    """Description and confidence from the reply when given; severity never changes."""
    parsed = parsed_replies(one_reply(replies, "classify"), "banking_risk_explanation string, confidence_score double")
    joined = _with_id(violations).join(parsed.select("violation_id", "r"), "violation_id", "left")
    score = F.col("r.confidence_score")
    return (
        joined
        .withColumn("description", F.coalesce(
            F.when(F.col("r.banking_risk_explanation") != "", F.col("r.banking_risk_explanation")),
            F.col("description")))
        .withColumn("confidence_score", F.coalesce(
            F.when(score != 0, score), F.col("confidence_score")))
        .drop("r")
    )


def merge_fixes(violations: DataFrame, replies: DataFrame, model: str = FIX_MODEL) -> DataFrame:
    """Fix rows from replies, checked for safety; a failed reply becomes an empty fix."""
    parsed = parsed_replies(one_reply(replies, "fix"), "fixed_code string, explanation string, confidence_score double")
    joined = _with_id(violations).join(
        parsed.select("violation_id", "r", "parse_error"), "violation_id", "left")
    failed = F.coalesce(F.col("parse_error"), F.when(F.col("r").isNull(), F.lit("no reply")))
    ok = F.col("failed").isNull()
    return (
        joined.withColumn("failed", failed)
        .withColumn("original_code", F.col("line_content"))
        .withColumn("fixed_code", F.when(ok, F.coalesce("r.fixed_code", F.lit(""))).otherwise(""))
        .withColumn("issues", unsafe_issues(F.col("fixed_code")))
        .withColumn("explanation", F.when(ok, F.coalesce("r.explanation", F.lit(""))).otherwise(
            F.concat(F.lit("Fix generation failed: "), F.col("failed"))))
        .withColumn("ai_model_used", F.lit(model))
        .withColumn("fix_confidence", F.when(ok, F.coalesce("r.confidence_score", F.lit(0.0))).otherwise(0.0))
        .withColumn("security_review_passed", ok & (F.size("issues") == 0))
        .withColumn("security_review_notes", F.when(~ok, F.concat(F.lit("Error: "), F.col("failed")))
                    .when(F.size("issues") > 0, F.array_join("issues", "; "))
                    .otherwise(VALIDATION_PASSED))
        .drop("r", "parse_error", "failed", "issues")
    )


def merge_reviews(fixes: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdict and notes from review replies; an empty fix is never passed."""
    schema = "approved boolean, review_notes string, issues array<struct<severity:string,issue:string>>"
    parsed = parsed_replies(one_reply(replies, "review"), schema)
    joined = fixes.join(parsed.select(
        "violation_id", "r", "parse_error", F.col("error").alias("call_error")), "violation_id", "left")
    issues = F.array_join(F.transform(F.col("r.issues"), lambda i: F.concat(
        F.coalesce(i["severity"], F.lit("UNKNOWN")), F.lit(": "), F.coalesce(i["issue"], F.lit("")))), "; ")
    notes = F.concat(
        F.coalesce("r.review_notes", F.lit("")),
        F.when(F.coalesce(F.size("r.issues"), F.lit(0)) > 0, F.concat(F.lit(" Issues: "), issues))
        .otherwise(""))
    empty = F.col("fixed_code") == ""
    called = F.coalesce(F.col("call_error"), F.lit("")) == ""
    return (
        joined
        .withColumn("security_review_passed", F.when(
            empty | F.col("r").isNull(), False).otherwise(F.coalesce("r.approved", F.lit(False))))
        .withColumn("security_review_notes", F.when(empty, F.lit("No fixed code to review"))
                    .when(~called, F.concat(F.lit("Review failed: "), F.col("call_error")))
                    .when(F.col("r").isNull(), F.concat(
                        F.lit("Review parse error: "), F.coalesce("parse_error", F.lit("no reply"))))
                    .otherwise(notes))
        .drop("r", "parse_error", "call_error")
    )


def run(violations: DataFrame, classify: DataFrame | None, fix: DataFrame,
        review: DataFrame | None) -> DataFrame:
    """Classify, fix, review, keep what passed; None skips the classification or the review."""
    if classify is not None:
        violations = merge_classification(violations, classify)
    fixes = merge_fixes(violations, fix)
    if review is None:
        return fixes
    return merge_reviews(fixes, review).where("security_review_passed")


def run_stats(violations: DataFrame | None, generated: DataFrame, approved: DataFrame) -> DataFrame:
    """One row of counts: classified, generated (not empty), approved, rejected."""
    marks = generated.select(F.when(F.col("fixed_code") != "", "full").otherwise("empty").alias("kind"))
    marks = marks.unionByName(approved.select(F.lit("approved").alias("kind")))
    if violations is not None:
        marks = marks.unionByName(violations.select(F.lit("classified").alias("kind")))

    def n(*kinds: str) -> Column:
        return F.count_if(F.col("kind").isin(*kinds))

    return marks.agg(
        n("classified").alias("violations_classified"), n("full").alias("fixes_generated"),
        n("approved").alias("fixes_approved"),
        (n("full", "empty") - n("approved")).alias("fixes_rejected"))
