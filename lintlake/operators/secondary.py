"""Secondary rule pack: stand-alone line rules per language, without deduplication.

A line may yield several hits; each is (type, line number, the line as it stands).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    CSHARP, JAVA, LONG_RUNNING_TXN, PYTHON, READ_PREFERENCE, SELECT_STAR, SQL, STRING_CONCAT_SQL,
)
from ..functions.text import NOCASE, UNICODE, fold_sql, quote, split_lines
from .lines import SQL_PACK_WINDOW, window_text
from .rules import (
    BEGIN_RX, CS_CONCAT_RX, COUNT_STAR_RX, EXISTS_STAR_RX, JAVA_CONCAT_RX, MAPPER_RX,
    SELECT_STAR_RX, SQL_CONCAT_RX, contains_any, search,
)
from .scan import with_file_columns

AHEAD_WINDOW = (0, 4)


@dataclass(frozen=True)
class PackRule:
    violation_type: str
    pattern: str
    none_of: tuple[str, ...] = ()
    also_case: str | None = None            # a second, case-sensitive pattern
    lacks: tuple[str, ...] = ()
    lacks_lower: tuple[str, ...] = ()
    lacks_in: tuple[str, str] | None = None         # (window column, word)
    lacks_in_upper: tuple[str, str] | None = None
    case_sensitive: bool = False


# --- fixed values: patterns of the pack, in emission order -----------------------

_STAR = PackRule(SELECT_STAR, SELECT_STAR_RX, none_of=(COUNT_STAR_RX, EXISTS_STAR_RX))
_QUOTED_STAR = PackRule(SELECT_STAR, r"""["']SELECT\s+\*""", none_of=(COUNT_STAR_RX,))
_STATEMENT = (
    r"(?:Statement|Query)\s+\w+\s*=\s*(?:connection|session|em)\."
    r"create(?:Statement|Query|NativeQuery)\s*\("
)
PACK: dict[str, tuple[PackRule, ...]] = {
    CSHARP: (
        _STAR,
        PackRule(STRING_CONCAT_SQL, CS_CONCAT_RX[0]),
        PackRule(STRING_CONCAT_SQL,
                 r"""(?:Database\.ExecuteSql|SqlQuery|RawSql)\s*\(\s*(?:\$|f)["']"""),
        PackRule(STRING_CONCAT_SQL, CS_CONCAT_RX[2]),
        PackRule(LONG_RUNNING_TXN, r"new\s+SqlCommand", lacks_in=("ahead", "CommandTimeout")),
    ),
    JAVA: (
        _QUOTED_STAR,
        PackRule(STRING_CONCAT_SQL,
                 r"""(?:createQuery|createNativeQuery|createStatement|executeQuery)\s*\([^)]*["'][^"']*["']\s*\+"""),
        PackRule(STRING_CONCAT_SQL, JAVA_CONCAT_RX[1], also_case=r"String\.format.*%[sd]"),
        PackRule(STRING_CONCAT_SQL, MAPPER_RX, case_sensitive=True),
        PackRule(STRING_CONCAT_SQL, _STATEMENT, lacks=("PreparedStatement",)),
        PackRule(LONG_RUNNING_TXN, _STATEMENT, lacks_in=("next_line", "setQueryTimeout")),
    ),
    PYTHON: (
        _QUOTED_STAR,
        PackRule(STRING_CONCAT_SQL, r"""(?:cursor|conn)\s*\.\s*execute\s*\(\s*f["']"""),
        PackRule(STRING_CONCAT_SQL,
                 r"""(?:cursor|conn)\s*\.\s*execute\s*\(["'][^"']*["']\s*%"""),
        PackRule(STRING_CONCAT_SQL, r"""(?:text|engine\.execute)\s*\(["'][^"']*["']\s*\+"""),
        PackRule(STRING_CONCAT_SQL,
                 r"""(?:\.raw|RawSQL)\s*\(\s*(?:f["']|["'][^"']*["']\s*%)"""),
        PackRule(READ_PREFERENCE, r"MongoClient\s*\(\s*[^)]*\)",
                 lacks_lower=("read_preference", "readpreference")),
        PackRule(LONG_RUNNING_TXN, r"psycopg2\.connect\s*\([^)]*\)", lacks=("connect_timeout",)),
    ),
    SQL: (
        _STAR,
        PackRule(STRING_CONCAT_SQL, r"""EXEC\s*\(\s*['"].*['"]\s*\+"""),
        PackRule(STRING_CONCAT_SQL, SQL_CONCAT_RX[1]),
        PackRule(LONG_RUNNING_TXN, r"DECLARE\s+\w+\s+CURSOR(?!.*(?:FAST_FORWARD|READ_ONLY))"),
        PackRule(LONG_RUNNING_TXN, BEGIN_RX,
                 lacks_in_upper=("around", "SET TRANSACTION ISOLATION")),
    ),
}
# words (folded) of which every matching line holds one
PACK_WORDS = {
    CSHARP: ("select", "insert", "update", "delete", "sqlcommand", "executesql", "sqlquery", "rawsql"),
    JAVA: ("select", "create", "executequery", "string.format", "${"),
    PYTHON: ("select", "execute", "text", ".raw", "rawsql", "mongoclient", "psycopg2.connect"),
    SQL: ("select", "exec", "cursor", "transaction"),
}


def _condition(rule: PackRule) -> str:
    tests = [search("line", rule.pattern, UNICODE if rule.case_sensitive else NOCASE)]
    tests += ["NOT " + search("line", p) for p in rule.none_of]
    if rule.also_case:
        tests.append(search("line", rule.also_case, UNICODE))
    tests += [f"NOT contains(line, {quote(w)})" for w in rule.lacks]
    tests += [f"NOT contains(lower(line), {quote(w)})" for w in rule.lacks_lower]
    if rule.lacks_in:
        tests.append(f"NOT contains({rule.lacks_in[0]}, {quote(rule.lacks_in[1])})")
    if rule.lacks_in_upper:
        tests.append(f"NOT contains(upper({rule.lacks_in_upper[0]}), {quote(rule.lacks_in_upper[1])})")
    return " AND ".join(tests)


def secondary_hits(files: DataFrame, language: str | None = None) -> DataFrame:
    """Hits of the pack for one language or all; narrow, no exchange."""
    languages = [language] if language else list(PACK)
    df = (
        with_file_columns(files).where(F.col("rule_language").isin(*languages))
        .select("file_path", "rule_language", split_lines(F.col("content")).alias("lines"),
                F.expr(f"split({fold_sql('content')}, '\\n', -1)").alias("folds"))
    )
    wanted = " OR ".join(
        f"(rule_language = {quote(name)} AND {contains_any('element_at(folds, n)', PACK_WORDS[name])})"
        for name in languages)
    rows = df.select("file_path", "rule_language", F.expr(
        f"explode(transform(filter(sequence(1, size(lines)), n -> {wanted}), n -> named_struct("
        f"'line_number', n, 'line', element_at(lines, n), 'ahead', {window_text(AHEAD_WINDOW)}, "
        f"'next_line', coalesce(get(lines, n), element_at(lines, n)), "
        f"'around', {window_text(SQL_PACK_WINDOW)})))"
    ).alias("c")).select("file_path", "rule_language", "c.*")
    hits = ", ".join(
        f"CASE WHEN rule_language = {quote(name)} AND {_condition(rule)} THEN "
        f"named_struct('violation_type', '{rule.violation_type}', 'emit_ord', {i}) END"
        for name in languages for i, rule in enumerate(PACK[name], 1))
    return (
        rows.select("file_path", "line_number", "line", F.expr(f"explode(array({hits}))").alias("h"))
        .where("h is not null")
        .select("file_path", "line_number", "h.violation_type", "line", "h.emit_ord")
    )
