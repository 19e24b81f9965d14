"""Masking of secrets and safety checks of proposed code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import REDACTED, SENSITIVE_KEYWORDS
from .text import NOCASE, UNICODE

# Fixed values: (pattern, ignore case, group whose text is reported; 0 = whole match).
SECRET_PATTERNS = (
    (r"(api[_-]?key|apikey|access[_-]?key)\s*[=:]\s*['\"]?([a-zA-Z0-9\-_.]+)['\"]?", True, 2),
    (r"(connection[_-]?string|server|host)\s*[=:]\s*['\"]?([^'\";]+)['\"]?", True, 2),
    (r"(password|passwd|pwd)\s*[=:]\s*['\"]?([^'\";]+)['\"]?", True, 2),
    (r"AKIA[0-9A-Z]{16}", False, 0),
    (r"-----BEGIN [A-Z ]+PRIVATE KEY-----", False, 0),
)
# The first 30 characters of each pattern, as published in the found list.
SECRET_LABELS = (
    r"(?i)(api[_-]?key|apikey|access",
    r"(?i)(connection[_-]?string|ser",
    r"(?i)(password|passwd|pwd)\s*[=",
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN [A-Z ]+PRIVATE KEY-",
)
# Patterns blanked in log text.
LOG_PATTERNS = (
    (r"(api[_-]?key|apikey|access[_-]?key)\s*[=:]\s*['\"]?([a-zA-Z0-9\-_.]+)['\"]?", True),
    (r"(password|passwd|pwd)\s*[=:]\s*['\"]?([^'\";]+)['\"]?", True),
    (r"(token)\s*[=:]\s*['\"]?([a-zA-Z0-9\-_.]+)['\"]?", True),
    (r"AKIA[0-9A-Z]{16}", False),
)
# Fixed values: (pattern, ignore case, issue text), in reporting order.
UNSAFE_PATTERNS = (
    (r"\beval\s*\(", False, "Dangerous eval() call detected - potential code injection"),
    (r"\bexec\s*\(", False, "Dangerous exec() call detected - potential code injection"),
    (r"\b__import__\s*\(", False, "Dangerous __import__() call detected"),
    (r"\bsystem\s*\(", False, "Dangerous system() call detected - potential shell injection"),
    (r"\bshell_exec\s*\(", False, "Dangerous shell_exec() call detected"),
    (r"subprocess\.\w+\([^)]*shell\s*=\s*True", False, "subprocess with shell=True detected"),
    (r"(password|passwd|pwd)\s*[=:]\s*[\"'][^\"']+[\"']", True, "Hardcoded credential detected in fix"),
    (r"(api[_-]?key|apikey)\s*[=:]\s*['\"][a-zA-Z0-9]+", True, "Hardcoded API key detected in fix"),
    (r"\b(EXECUTE|EXEC)\s+\(.*\+", True, "Suspicious EXEC with concatenation in fix"),
    (r"/\*.*\*/", False, "SQL block comment detected - could hide injection"),
)


def _flags(ignore_case: bool) -> str:
    return NOCASE if ignore_case else UNICODE


def mask_secrets(col: Column, patterns=SECRET_PATTERNS) -> Column:
    """Each pattern is blanked in the text the patterns before it have left."""
    for pattern, ignore_case, *_ in patterns:
        col = F.regexp_replace(col, _flags(ignore_case) + pattern, REDACTED)
    return col


def mask_log_text(col: Column) -> Column:
    return mask_secrets(col, LOG_PATTERNS)


def _labelled(values: Column, label: str) -> Column:
    return F.transform(
        values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))


def secrets_found(col: Column) -> Column:
    """array<struct<label, value>> of what ``mask_secrets`` takes out, in order."""
    found, stage = [], col
    for (pattern, ignore_case, group), label in zip(SECRET_PATTERNS, SECRET_LABELS):
        flagged = _flags(ignore_case) + pattern
        values = F.regexp_extract_all(stage, F.lit(flagged), F.lit(group))
        found.append(_labelled(F.filter(values, lambda v: v != ""), label))
        stage = F.regexp_replace(stage, flagged, REDACTED)
    return F.concat(*found)


def mask_log_columns(df: DataFrame) -> DataFrame:
    """Blank secrets in every string column."""
    return df.select(*[
        mask_log_text(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def _sensitive(name: str) -> bool:
    return any(word in name.lower() for word in SENSITIVE_KEYWORDS)


def _sensitive_key(key: Column) -> Column:
    out = F.lit(False)
    for word in SENSITIVE_KEYWORDS:
        out = out | F.lower(key).contains(word)
    return out


def _mask_value(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[
            (F.lit(REDACTED) if _sensitive(f.name) else _mask_value(col.getField(f.name), f.dataType))
            .alias(f.name)
            for f in dtype.fields
        ]))
    if isinstance(dtype, T.MapType):
        if not isinstance(dtype.keyType, T.StringType):
            return F.transform_values(col, lambda k, v: _mask_value(v, dtype.valueType))
        # what is no text cannot become a text inside a typed map: under a sensitive key it is blanked
        mask = F.lit(REDACTED if isinstance(dtype.valueType, T.StringType) else None)
        return F.transform_values(
            col, lambda k, v: F.when(_sensitive_key(k), mask).otherwise(_mask_value(v, dtype.valueType)))
    return col  # lists and scalars stay


def mask_fields(df: DataFrame) -> DataFrame:
    """Blank values whose name holds a sensitive word, in nested records and maps too."""
    return df.select(*[
        (F.lit(REDACTED) if _sensitive(f.name) else _mask_value(F.col(f"`{f.name}`"), f.dataType))
        .alias(f.name)
        for f in df.schema.fields
    ])


def unsafe_issues(code: Column) -> Column:
    """array<string> of the safety issues of a proposed fix, in rule order."""
    return F.array_compact(F.array(*[
        F.when(code.rlike(_flags(ignore_case) + pattern), F.lit(message))
        for pattern, ignore_case, message in UNSAFE_PATTERNS
    ]))
