"""The rule table: line rules as data, compiled to SQL conditions.

To add a check, append a ``Rule`` (pattern, language, windows, message); nothing else
in the scan changes and no Python runs per line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..fixed import (
    CSHARP, JAVA, LONG_RUNNING_TXN, PYTHON, READ_PREFERENCE, SELECT_STAR, SQL,
    STRING_CONCAT_SQL, UNBATCHED_TXN,
)
from ..functions.text import NOCASE, UNICODE, quote
from .lines import LONG_TXN_WINDOW


@dataclass(frozen=True)
class Detector:
    """What all rules of one detector share."""

    violation_type: str
    ord: int                        # registration order; the first hit on a line wins
    confidence: float
    language: str = "rule"          # which language column its rules test and report
    platform: str = "base"          # which platform column it reports
    routes: tuple[str, ...] = ()    # routed languages; empty = all
    mongo_files_only: bool = False


@dataclass(frozen=True)
class Rule:
    """One line rule. All tests must hold; ``any_of`` is an OR."""

    name: str
    detector: str
    any_of: tuple[str, ...]
    description: str
    needs: tuple[str, ...]          # folded words, one of which is on every matching line
    language: str | None = None     # None = any
    none_of: tuple[str, ...] = ()   # regexes that must not be on the line
    lacks: tuple[str, ...] = ()     # case-sensitive words that must not be on the line
    lacks_lower: tuple[str, ...] = ()    # words that must not be on the lower-cased line
    window: tuple[int, int] | None = None
    window_lacks: tuple[str, ...] = ()       # case-sensitive words not in the window
    window_lacks_upper: tuple[str, ...] = ()  # words not in the upper-cased window
    after: tuple[str, ...] = ()     # regexes of an earlier branch that must not match
    case_sensitive: tuple[str, ...] = ()     # alternatives tested with case


@dataclass(frozen=True)
class WindowRule:
    """Loop rule: a regex over the lines n..n+15, in which a call word must occur."""

    name: str
    language: str
    pattern: str
    call_words: tuple[str, ...]     # folded


DETECTORS = {
    "select_star": Detector(SELECT_STAR, 1, 0.98, platform="select"),
    "string_concat": Detector(STRING_CONCAT_SQL, 2, 0.95, language="concat"),
    "unbatched": Detector(UNBATCHED_TXN, 3, 0.85, routes=(CSHARP, JAVA, PYTHON)),
    "long_txn": Detector(LONG_RUNNING_TXN, 4, 0.80, platform="longtxn"),
    "read_pref": Detector(READ_PREFERENCE, 5, 0.90, platform="mongo",
                          routes=(CSHARP, JAVA, PYTHON), mongo_files_only=True),
}
FLOW_ORD = 6  # statement and scope checks come after all line rules

# --- fixed values: patterns and messages of the line rules ---------------------

SELECT_STAR_RX = r"SELECT\s+\*(?!\s*\))"
COUNT_STAR_RX = r"COUNT\s*\(\s*\*\s*\)"
EXISTS_STAR_RX = r"EXISTS\s*\(\s*SELECT\s+\*"

CS_CONCAT_RX = (
    r"""(?:SqlCommand|ExecuteSql|SqlQuery)\s*\([^)]*["'][^"']*["']\s*\+""",
    r"""(?:SqlCommand|ExecuteSql|SqlQuery|Database\.Sql)\s*\(\s*(?:\$|f)["']""",
    r"""\$"[^"]*(?:SELECT|INSERT|UPDATE|DELETE)[^"]*\{""",
    r"""string\.Format\s*\(\s*["'](?:SELECT|INSERT|UPDATE|DELETE)""",
    r"""["'](?:SELECT|INSERT|UPDATE|DELETE)\s[^"']*["']\s*\+""",
)
JAVA_CONCAT_RX = (
    r"""(?:createQuery|createNativeQuery|executeQuery|prepareStatement)\s*\([^)]*["'][^"']*["']\s*\+""",
    r"""String\.format\s*\(\s*["'](?:SELECT|INSERT|UPDATE|DELETE)[^"']*%[sd][^"']*["']""",
)
MAPPER_RX = r"\$\{[^}]+\}"
PY_CONCAT_RX = (
    r"""(?:execute|executemany|query|run)\s*\(\s*f["'].*(?:SELECT|INSERT|UPDATE|DELETE)""",
    r"""(?:execute|executemany|query|run)\s*\(["'][^"']*%[sd][^"']*["']\s*%""",
    r"""(?:execute|executemany|query|run)\s*\(["'][^"']*["']\s*\+""",
    r"""f["'](?:SELECT|INSERT|UPDATE|DELETE)\s[^"']*\{""",
)
SQL_CONCAT_RX = (
    r"""(?:EXEC|EXECUTE)\s*\(\s*['"][^'"]*['"]\s*\+""",
    r"EXECUTE\s+IMMEDIATE\s+.*\|\|",
)
SCOPE_RX = r"new\s+TransactionScope\s*\("
SQLCOMMAND_RX = r"new\s+SqlCommand\s*\("
TRANSACTIONAL_RX = r"@Transactional"
STATEMENT_RX = r"(?:connection|conn)\s*\.\s*createStatement\s*\("
CONNECT_RX = r"psycopg2\.connect\s*\("
CURSOR_RX = r"DECLARE\s+\w+\s+CURSOR(?!.*FAST_FORWARD)"
BEGIN_RX = r"BEGIN\s+(?:DISTRIBUTED\s+)?TRANSACTION"
CS_LOOP_RX = r"(?:foreach|for)\s*\([^)]*\)\s*\{[^}]*(?:SaveChanges|ExecuteNonQuery|Execute)\s*\("
JAVA_LOOP_RX = (
    r"(?:for|foreach)\s*\([^)]*\)\s*\{[^}]*"
    r"(?:em\.persist|session\.save|entityManager\.persist|\.persist)\s*\("
)
PY_LOOP_RX = r"for\s+\w+\s+in\s+\w+.*:.*(?:insert_one|update_one|delete_one)\s*\("
PY_MONGO_RX = r"MongoClient\s*\("
JAVA_MONGO_RX = r"MongoClient(?:Settings)?\.(?:create|from)\s*\("
CS_MONGO_RX = r"new\s+MongoClient\s*\("

SELECT_STAR_TEXT = (
    "SELECT * query detected. Avoid selecting all columns; specify only required columns. "
    "This improves performance, reduces network overhead, and limits schema exposure."
)
CONCAT_TEXT = (
    "SQL Injection Risk: Query constructed via string concatenation or interpolation. "
    "Use parameterized queries or prepared statements."
)
UNBATCHED_TEXT = (
    "Unbatched transaction detected: Loop with individual database operations. "
    "This causes N+1 query problems. Use batch operations instead."
)
SCOPE_TEXT = (
    "TransactionScope without timeout. Set TransactionOptions.Timeout to prevent indefinite locks."
)
SQLCOMMAND_TEXT = (
    "SqlCommand without CommandTimeout configured. Set CommandTimeout to prevent "
    "long-running queries from locking resources."
)
TRANSACTIONAL_TEXT = (
    "@Transactional without timeout. Add timeout parameter to prevent indefinite transaction locks."
)
STATEMENT_TEXT = (
    "Statement created without setQueryTimeout. Call setQueryTimeout() to prevent "
    "long-running queries."
)
CONNECT_TEXT = (
    "Database connection without timeout. Add connect_timeout parameter to prevent "
    "indefinite connection attempts."
)
CURSOR_TEXT = (
    "DECLARE CURSOR without FAST_FORWARD or READ_ONLY. Add these hints to improve performance."
)
BEGIN_TEXT = (
    "BEGIN TRANSACTION without explicit isolation level. Set isolation level for consistency."
)
PY_MONGO_TEXT = (
    "MongoClient created without read_preference. Specify read_preference for replicated deployments."
)
JAVA_MONGO_TEXT = (
    "MongoClient without readPreference configuration. Add ReadPreference to route reads appropriately."
)
CS_MONGO_TEXT = (
    "MongoClient without ReadPreference. Configure ReadPreference for optimal read distribution."
)

# --- the table -----------------------------------------------------------------

_DML = ("select", "insert", "update", "delete")

RULES: tuple[Rule, ...] = (
    Rule("select_star", "select_star", (SELECT_STAR_RX,), SELECT_STAR_TEXT, ("select",),
         none_of=(COUNT_STAR_RX, EXISTS_STAR_RX)),
    Rule("concat_csharp", "string_concat", CS_CONCAT_RX, CONCAT_TEXT,
         ("sqlcommand", "executesql", "sqlquery", "database.sql") + _DML, language=CSHARP),
    Rule("concat_java", "string_concat", JAVA_CONCAT_RX, CONCAT_TEXT,
         ("createquery", "createnativequery", "executequery", "preparestatement",
          "string.format", "${"),
         language=JAVA, case_sensitive=(MAPPER_RX,)),
    Rule("concat_python", "string_concat", PY_CONCAT_RX, CONCAT_TEXT,
         ("execute", "query", "run") + _DML, language=PYTHON),
    Rule("concat_sql", "string_concat", SQL_CONCAT_RX, CONCAT_TEXT, ("exec",), language=SQL),
    Rule("longtxn_scope", "long_txn", (SCOPE_RX,), SCOPE_TEXT, ("transactionscope",),
         language=CSHARP, window=LONG_TXN_WINDOW,
         window_lacks=("Timeout", "TransactionOptions")),
    Rule("longtxn_sqlcommand", "long_txn", (SQLCOMMAND_RX,), SQLCOMMAND_TEXT, ("sqlcommand",),
         language=CSHARP, after=(SCOPE_RX,), window=LONG_TXN_WINDOW,
         window_lacks=("CommandTimeout",)),
    Rule("longtxn_transactional", "long_txn", (TRANSACTIONAL_RX,), TRANSACTIONAL_TEXT,
         ("@transactional",), language=JAVA, lacks_lower=("timeout",)),
    Rule("longtxn_statement", "long_txn", (STATEMENT_RX,), STATEMENT_TEXT, ("createstatement",),
         language=JAVA, after=(TRANSACTIONAL_RX,), window=LONG_TXN_WINDOW,
         window_lacks=("setQueryTimeout",)),
    Rule("longtxn_connect", "long_txn", (CONNECT_RX,), CONNECT_TEXT, ("psycopg2.connect",),
         language=PYTHON, lacks=("connect_timeout",)),
    Rule("longtxn_cursor", "long_txn", (CURSOR_RX,), CURSOR_TEXT, ("cursor",),
         language=SQL, lacks=("FAST_FORWARD", "READ_ONLY")),
    Rule("longtxn_begin", "long_txn", (BEGIN_RX,), BEGIN_TEXT, ("transaction",),
         language=SQL, after=(CURSOR_RX,), window=LONG_TXN_WINDOW,
         window_lacks_upper=("SET TRANSACTION ISOLATION",)),
    Rule("readpref_python", "read_pref", (PY_MONGO_RX,), PY_MONGO_TEXT, ("mongoclient",),
         language=PYTHON, lacks_lower=("read_preference", "readpreference")),
    Rule("readpref_java", "read_pref", (JAVA_MONGO_RX,), JAVA_MONGO_TEXT, ("mongoclient",),
         language=JAVA, lacks_lower=("readpreference",)),
    Rule("readpref_csharp", "read_pref", (CS_MONGO_RX,), CS_MONGO_TEXT, ("mongoclient",),
         language=CSHARP, lacks_lower=("readpreference",)),
)

LOOP_RULES: tuple[WindowRule, ...] = (
    WindowRule("unbatched_csharp", CSHARP, CS_LOOP_RX, ("savechanges", "execute")),
    WindowRule("unbatched_java", JAVA, JAVA_LOOP_RX, (".persist", "session.save")),
    WindowRule("unbatched_python", PYTHON, PY_LOOP_RX,
               ("insert_one", "update_one", "delete_one")),
)


# --- compilation to SQL conditions ----------------------------------------------


def search(expr: str, pattern: str, flags: str = NOCASE) -> str:
    return f"{expr} RLIKE {quote(flags + pattern)}"


def contains_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {word(w)})" for w in words) + ")"


def word(text: str) -> str:
    """A word as a literal; ``${`` is kept away from variable substitution."""
    return quote(text) if "${" not in text else "concat('$', " + quote(text.replace("$", "", 1)) + ")"


def window_column(span: tuple[int, int]) -> str:
    lo, hi = span
    return f"w_{'m' if lo < 0 else ''}{abs(lo)}_{hi}"


def windows_of(rules) -> list[tuple[int, int]]:
    return sorted({r.window for r in rules if r.window})


def route_condition(detector: Detector) -> str:
    routes = ", ".join(quote(r) for r in detector.routes)
    return f"route_language IN ({routes})" if routes else "true"


# rule languages a file can have when its mapper-aware language is the key
_RULE_LANGUAGES = {CSHARP: (CSHARP,), JAVA: (JAVA, SQL), PYTHON: (PYTHON,), SQL: (SQL,)}


def gate_condition(rules, folded: str) -> str:
    """Necessary for any of ``rules``: the folded text holds a word of a rule of its language.

    One alternation of plain words per language, so a text is searched once.
    """
    whens = []
    for language, rule_languages in _RULE_LANGUAGES.items():
        words: set[str] = set()
        for r in rules:
            own = (language,) if DETECTORS[r.detector].language == "concat" else rule_languages
            if r.language is None or r.language in own:
                words |= set(r.needs)
        # a word is redundant when another one is part of it
        words = {w for w in words if not any(o != w and o in w for o in words)}
        if words:
            pattern = "|".join(re.escape(w) for w in sorted(words))
            whens.append(f"WHEN {quote(language)} THEN {folded} RLIKE {quote(pattern)}")
    return f"(CASE concat_language {' '.join(whens)} ELSE false END)"


def rule_condition(rule: Rule) -> str:
    """Condition over the columns line, *_language, route_language, is_mongo and windows."""
    det = DETECTORS[rule.detector]
    tests: list[str] = []
    if rule.language is not None:
        tests.append(f"{det.language}_language = {quote(rule.language)}")
    if det.routes:
        tests.append(route_condition(det))
    if det.mongo_files_only:
        tests.append("is_mongo")
    tests += [f"NOT contains(line, {word(w)})" for w in rule.lacks]
    tests += [f"NOT contains(lower(line), {word(w)})" for w in rule.lacks_lower]
    tests.append("(" + " OR ".join(
        [search("line", p) for p in rule.any_of]
        + [search("line", p, UNICODE) for p in rule.case_sensitive]
    ) + ")")
    tests += ["NOT " + search("line", p) for p in rule.none_of + rule.after]
    if rule.window:
        window = window_column(rule.window)
        tests += [f"NOT contains({window}, {word(w)})" for w in rule.window_lacks]
        tests += [f"NOT contains(upper({window}), {word(w)})" for w in rule.window_lacks_upper]
    return " AND ".join(tests)
