"""Template fixes: rewriting, selection, approval and application to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    CRITICAL, CSHARP, DEFAULT_COLUMNS, DRY_RUN_TEXT, FIX_MODEL, FIX_TEXT, FIX_WHY, HIGH, JAVA,
    LONG_RUNNING_TXN, MAX_FIX_BATCH, PYTHON, READ_PREFERENCE, SELECT_STAR, SQL,
    STRING_CONCAT_SQL, TABLE_COLUMNS, TEMPLATE_CONFIDENCE, TEMPLATE_MODEL, TEMPLATE_NOTES,
    UNBATCHED_TXN, WEB_APPROVAL_CONFIDENCE,
)
from ..functions.secrets import unsafe_issues
from ..functions.text import (
    NOCASE, UNICODE, base_name, replace_all, strip, violation_id, whole_percent,
)

_STAR_FROM = r"SELECT\s+\*\s+FROM\s+(\w+)"
_CS_JOINED = r"""["']\s*\+\s*(\w+)\s*\+\s*["']"""
_FSTRING = r"""f(["'])(.*?)\{(\w+)\}(.*?)\1"""


def _line() -> Column:
    return F.col("stripped")


def _lang(name: str) -> Column:
    return F.col("language") == name


def _pair(fixed: Column, why: str | Column) -> Column:
    return F.struct(fixed.alias("fixed"), (F.lit(why) if isinstance(why, str) else why).alias("why"))


def _append(key: str, why: str) -> Column:
    return _pair(F.concat(_line(), F.lit(FIX_TEXT[key])), FIX_WHY[why])


def _select_star() -> Column:
    found = F.regexp_extract(_line(), NOCASE + _STAR_FROM, 1)
    table = F.when(found != "", found).otherwise("table")
    columns = F.lit(DEFAULT_COLUMNS)
    for key, names in reversed(TABLE_COLUMNS.items()):
        columns = F.when(F.lower(table).contains(key), F.lit(names)).otherwise(columns)
    before, between, after = FIX_WHY["select_star"].split("%s")
    return _pair(
        F.regexp_replace(_line(), F.lit(NOCASE + r"SELECT\s+\*"), F.concat(F.lit("SELECT "), columns)),
        F.concat(F.lit(before), columns, F.lit(between), table, F.lit(after)),
    )


def _string_concat() -> Column:
    line = _line()
    head, tail = FIX_TEXT["concat_cs_param"]
    joined = F.regexp_replace(line, UNICODE + _CS_JOINED, head + "$1" + tail)
    cs = _pair(
        F.when(joined == line, F.concat(line, F.lit(FIX_TEXT["concat_cs"]))).otherwise(joined),
        FIX_WHY["concat_cs"],
    )
    mapper = _pair(F.regexp_replace(line, UNICODE + r"\$\{(\w+)\}", "#{$1}"), FIX_WHY["concat_mapper"])
    fstring = _pair(
        F.regexp_replace(line, UNICODE + _FSTRING, "$1$2%s$4$1, ($3,)"), FIX_WHY["concat_fstring"])
    return (
        F.when(_lang(CSHARP) & (line.contains("$") | line.contains("+")), cs)
        .when(_lang(JAVA) & line.contains("${"), mapper)
        .when(_lang(JAVA) & line.contains("+"), _append("concat_java", "concat_java"))
        .when(_lang(PYTHON) & (line.contains('f"') | line.contains("f'")), fstring)
        .when(_lang(PYTHON) & line.contains("+"), _append("concat_py", "concat_py"))
        .when(_lang(SQL) & F.upper(line).contains("EXEC("), _append("concat_sql", "concat_sql"))
        .otherwise(_append("concat_other", "concat_other"))
    )


def _unbatched() -> Column:
    return (
        F.when(_lang(CSHARP), _append("unbatched_cs", "unbatched_cs"))
        .when(_lang(JAVA), _append("unbatched_java", "unbatched_java"))
        .when(_lang(PYTHON), _append("unbatched_py", "unbatched_py"))
        .otherwise(_append("unbatched_other", "unbatched_other"))
    )


def _long_running() -> Column:
    line = _line()
    command = line.contains("SqlCommand") | line.contains("NpgsqlCommand") | line.contains("OracleCommand")
    return (
        F.when(_lang(CSHARP) & command, _append("long_cs_command", "long_cs_command"))
        .when(_lang(CSHARP) & line.contains("TransactionScope"),
              _pair(replace_all(line, "TransactionScope()", FIX_TEXT["long_cs_scope"]),
                    FIX_WHY["long_cs_scope"]))
        .when(_lang(JAVA) & line.contains("@Transactional"),
              _pair(replace_all(line, "@Transactional", FIX_TEXT["long_java_annotation"]),
                    FIX_WHY["long_java_annotation"]))
        .when(_lang(JAVA) & line.contains("createStatement"),
              _append("long_java_statement", "long_java_statement"))
        .when(_lang(PYTHON) & line.contains("connect("),
              _pair(replace_all(line, ")", FIX_TEXT["long_py"]), FIX_WHY["long_py"]))
        .otherwise(_append("long_other", "long_other"))
    )


def _read_preference() -> Column:
    line = _line()
    return (
        F.when(_lang(PYTHON) & line.contains("MongoClient("),
               _pair(replace_all(line, "MongoClient(", FIX_TEXT["read_py"]), FIX_WHY["read_py"]))
        .when(_lang(JAVA), _append("read_java", "read_java"))
        .when(_lang(CSHARP) & line.contains("MongoClient("), _append("read_cs", "read_cs"))
        .otherwise(_append("read_other", "read_other"))
    )


_TEMPLATES = {
    SELECT_STAR: _select_star,
    STRING_CONCAT_SQL: _string_concat,
    UNBATCHED_TXN: _unbatched,
    LONG_RUNNING_TXN: _long_running,
    READ_PREFERENCE: _read_preference,
}


def template_fixes(violations: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the proposed fix to each violation; narrow, all types in one CASE."""
    names = types or tuple(_TEMPLATES)
    vtype = F.col("violation_type")
    proposal, confidence = None, None
    for name in names:
        if proposal is None:
            proposal = F.when(vtype == name, _TEMPLATES[name]())
            confidence = F.when(vtype == name, F.lit(TEMPLATE_CONFIDENCE[name]))
        else:
            proposal = proposal.when(vtype == name, _TEMPLATES[name]())
            confidence = confidence.when(vtype == name, F.lit(TEMPLATE_CONFIDENCE[name]))
    known = F.coalesce(F.col("p.fixed"), F.lit("")) != ""
    why = F.coalesce(F.col("p.why"), F.lit(FIX_WHY["no_template"]))
    return (
        violations.where(vtype.isin(*names) if types else F.lit(True))
        .withColumn("stripped", strip(F.col("line_content")))
        .withColumn("p", proposal)
        .withColumn("violation_id", violation_id(F.col("file_path"), F.col("line_number"), vtype))
        .withColumn("original_code", F.col("line_content"))
        .withColumn("fixed_code", F.coalesce("p.fixed", F.lit("")))
        .withColumn("explanation", why)
        .withColumn("ai_model_used", F.lit(TEMPLATE_MODEL))
        .withColumn("fix_confidence", F.when(known, confidence).otherwise(0.0))
        .withColumn("security_review_passed", known)
        .withColumn("security_review_notes", F.when(known, F.lit(TEMPLATE_NOTES)).otherwise(why))
        .drop("stripped", "p")
    )


def dry_run_fixes(violations: DataFrame, model: str = FIX_MODEL) -> DataFrame:
    return (
        violations
        .withColumn("violation_id", violation_id(
            F.col("file_path"), F.col("line_number"), F.col("violation_type")))
        .withColumn("original_code", F.col("line_content"))
        .withColumn("fixed_code", F.lit(""))
        .withColumn("explanation", F.lit(DRY_RUN_TEXT))
        .withColumn("ai_model_used", F.lit(model))
        .withColumn("fix_confidence", F.lit(0.0))
        .withColumn("security_review_passed", F.lit(False))
        .withColumn("security_review_notes", F.lit(""))
    )


ORDER = ("file_path", "detector_ord", "emit_ord")


def select_batch(violations: DataFrame, limit: int = MAX_FIX_BATCH) -> DataFrame:
    """All CRITICAL first, then the first HIGH of each type no CRITICAL has; the first ``limit``.

    The HIGH part is one aggregate over five types with map-side combine, the limit a top-k,
    so nothing is collected into one task.
    """
    critical = violations.where(F.col("severity") == CRITICAL).withColumn("tier", F.lit(0))
    is_high = F.col("severity") == HIGH
    first_high = (
        violations.groupBy("violation_type").agg(
            F.bool_or(F.col("severity") == CRITICAL).alias("has_critical"),
            F.min_by(F.struct(*violations.columns), F.when(is_high, F.struct(*ORDER))).alias("v"))
        .where("NOT has_critical").select("v.*").withColumn("tier", F.lit(1))
    )
    return critical.unionByName(first_high).orderBy("tier", *ORDER).limit(limit)


def fallback(ai_fixes: DataFrame, templates: DataFrame) -> DataFrame:
    """The model's fix where it is not empty, else the template's."""
    ai = ai_fixes.select("violation_id", *[
        F.col(c).alias(f"ai_{c}") for c in ("fixed_code", "explanation", "ai_model_used", "fix_confidence")])
    use = F.coalesce(F.col("ai_fixed_code"), F.lit("")) != ""
    joined = templates.join(ai, "violation_id", "left")
    for c in ("explanation", "ai_model_used", "fix_confidence"):
        joined = joined.withColumn(c, F.when(use, F.col(f"ai_{c}")).otherwise(F.col(c)))
    return joined.withColumn(
        "fixed_code", F.when(use, F.col("ai_fixed_code")).otherwise(F.col("fixed_code"))
    ).select(*templates.columns)


def fix_rows(fixes: DataFrame) -> DataFrame:
    """Flat rows with the texts cut to their display lengths."""
    return fixes.select(
        F.col("violation_type").alias("type"), base_name(F.col("file_path")).alias("file"),
        F.col("file_path").alias("relative_path"), F.col("line_number").alias("line"),
        F.substring("original_code", 1, 300).alias("original"),
        F.substring("fixed_code", 1, 600).alias("fixed"),
        F.substring("explanation", 1, 300).alias("explanation"),
        F.col("fix_confidence").alias("confidence"),
        (F.col("fixed_code") != "").alias("has_fix"),
    )


def validated(fixes: DataFrame) -> DataFrame:
    """Adds issues and is_valid."""
    return fixes.withColumn("issues", unsafe_issues(F.col("fixed_code"))).withColumn(
        "is_valid", F.size("issues") == 0)


def approve_web(fixes: DataFrame) -> DataFrame:
    """Non-empty fixes with approved = valid or confident enough, and the note."""
    confident = F.col("fix_confidence") >= WEB_APPROVAL_CONFIDENCE
    return (
        validated(fixes.where(F.col("fixed_code") != ""))
        .withColumn("approved", F.col("is_valid") | confident)
        .withColumn("notes", F.when(F.col("is_valid"), F.lit("Passed validation"))
                    .when(confident, F.concat(
                        F.lit("Approved (confidence "), whole_percent(F.col("fix_confidence")), F.lit(")")))
                    .otherwise(F.array_join("issues", "; ")))
    )


def approve_reviewed(fixes: DataFrame, skip_review: bool = False) -> DataFrame:
    return fixes if skip_review else fixes.where("security_review_passed")


def _fold(files: DataFrame, fixes: DataFrame, step: str) -> DataFrame:
    """Apply a file's fixes one after the other, each to the text the last has left.

    A file's fixes are at most its findings, and a file is bounded by the size cap.
    """
    per_file = (
        fixes.where("fixed_code <> ''").groupBy("file_path")
        .agg(F.sort_array(F.collect_list(F.struct(
            "detector_ord", "emit_ord", "original_code", "fixed_code"))).alias("fixes"))
    )
    return (
        files.join(per_file, "file_path")
        .withColumn("r", F.expr(
            f"aggregate(fixes, named_struct('content', content, 'applied', 0), (acc, f) -> {step})"))
        .select("file_path", F.col("r.content").alias("content"), F.col("r.applied").alias("applied"))
    )


def apply_first(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Each fix replaces the first occurrence of its original text, when there is one."""
    return _fold(files, fixes, (
        "CASE WHEN position(f.original_code, acc.content) > 0 THEN named_struct('content', "
        "overlay(acc.content PLACING f.fixed_code FROM position(f.original_code, acc.content) "
        "FOR length(f.original_code)), 'applied', acc.applied + 1) ELSE acc END"))


def apply_all(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Each fix replaces every occurrence of its original text."""
    return _fold(files, fixes, (
        "named_struct('content', replace(acc.content, f.original_code, f.fixed_code), "
        "'applied', acc.applied + 1)"))


__all__ = [
    "template_fixes", "dry_run_fixes", "select_batch", "fallback", "fix_rows", "validated",
    "approve_web", "approve_reviewed", "apply_first", "apply_all",
]
