"""SQL to compare the queries with, for an independent engine.

The corpus is rebuilt from ``events`` in plain SQL; windows are window functions there,
look-aheads are written out, back-references are split into their alternatives.
"""

from __future__ import annotations

from ..fixed import (
    CLASSIFY_PROMPT, DEFAULT_COLUMNS, FIX_MODEL, FIX_PROMPT, FIX_TEXT, FIX_WHY, REDACTED,
    REVIEW_MODEL, REVIEW_PROMPT, SCAN_MODEL, TABLE_COLUMNS, TEMPLATE_CONFIDENCE, TEMPLATE_NOTES,
    TRUNCATION_MARKER,
)
from ..functions.secrets import LOG_PATTERNS, SECRET_LABELS, SECRET_PATTERNS, UNSAFE_PATTERNS
from ..operators import rules as r
from ..operators.manifest import TYPE_OF_WORD
from .corpus import FILES_PER_REPO, corpus_sql

FLOW_LANGUAGES = "('C#', 'JAVA', 'PYTHON')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(column: str, pattern: str, options: str = "i") -> str:
    return f"regexp_matches({column}, {q(pattern)}, {q(options)})"


def any_m(column: str, patterns) -> str:
    return "(" + " OR ".join(m(column, p) for p in patterns) + ")"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


STAR = r"SELECT\s+\*\s*([^\s)]|$)"


def _has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def _platform(mongo: tuple[str, ...], oracle_path: bool = False) -> str:
    oracle = _has("low", "oracleconnection", "cx_oracle")
    if oracle_path:
        oracle += " OR contains(lower(file_path), 'oracle')"
    return (f"CASE WHEN {_has('low', *mongo)} THEN 'MONGODB' WHEN {oracle} THEN 'ORACLE' "
            f"WHEN {_has('low', 'yugabyte', 'npgsql')} THEN 'EDB_YUGABYTE' ELSE 'MSSQL' END")


META = f"""
meta AS (
  SELECT *, lower(content) AS low,
    CASE ext WHEN '.cs' THEN 'C#' WHEN '.py' THEN 'PYTHON' WHEN '.sql' THEN 'SQL' ELSE 'JAVA' END AS route_language,
    CASE ext WHEN '.cs' THEN 'C#' WHEN '.py' THEN 'PYTHON' WHEN '.java' THEN 'JAVA' ELSE 'SQL' END AS rule_language,
    CASE ext WHEN '.cs' THEN 'C#' WHEN '.py' THEN 'PYTHON' WHEN '.sql' THEN 'SQL' ELSE 'JAVA' END AS concat_language
  FROM code_files),
files AS (
  SELECT repo, file_path, content, route_language, rule_language, concat_language,
    {_platform(('mongoclient', 'pymongo'))} AS platform_base,
    {_platform(('mongoclient', 'pymongo'), True)} AS platform_select,
    {_platform(('mongoclient',))} AS platform_longtxn,
    ({_has('low', 'mongoclient', 'pymongo')} OR contains(lower(file_path), 'mongo')) AS is_mongo
  FROM meta)"""


def _window(lo: int, hi: int) -> str:
    def edge(n: int) -> str:
        return f"{-n} PRECEDING" if n < 0 else "CURRENT ROW" if n == 0 else f"{n} FOLLOWING"

    return (f"coalesce(string_agg(line, chr(10)) OVER (PARTITION BY file_path ORDER BY line_number "
            f"ROWS BETWEEN {edge(lo)} AND {edge(hi)}), '')")


SRC = f"""
windowed AS (
  SELECT repo, file_path, line_number, line, {_window(0, 15)} AS w16, {_window(-2, 5)} AS w8,
    {_window(0, 4)} AS w5, {_window(-4, 10)} AS w15,
    coalesce(lead(line) OVER (PARTITION BY file_path ORDER BY line_number), line) AS next_line,
    {_window(-3, -1)} AS ctx_before, {_window(1, 3)} AS ctx_after
  FROM code_lines),
src AS (
  SELECT w.*, f.route_language, f.rule_language, f.concat_language, f.platform_base,
    f.platform_select, f.platform_longtxn, f.is_mongo
  FROM windowed w JOIN files f USING (file_path))"""

_LANG = "rule_language = {}"
_LOOPS = (("unbatched_csharp", "C#", r.CS_LOOP_RX), ("unbatched_java", "JAVA", r.JAVA_LOOP_RX),
          ("unbatched_python", "PYTHON", r.PY_LOOP_RX))


def _branch(rule: str, ord_: int, vtype: str, platform: str, language: str, text: str,
            confidence: float, where: str) -> str:
    level = "CRITICAL" if vtype == "STRING_CONCAT_SQL" else "HIGH"
    return (
        f"SELECT '{rule}' AS rule, {ord_} AS detector_ord, line_number AS emit_ord, repo, file_path, "
        f"line_number, {strip('line')} AS line_content, '{vtype}' AS violation_type, '{level}' AS severity, "
        f"{platform} AS platform, {language} AS language, {q(text)} AS description, "
        f"CAST({confidence} AS DOUBLE) AS confidence_score, ctx_before, ctx_after FROM src WHERE {where}")


def _long(rule: str, language: str, text: str, where: str) -> str:
    return _branch(rule, 4, "LONG_RUNNING_TXN", "platform_longtxn", "rule_language", text, 0.80,
                   f"rule_language = '{language}' AND {where}")


def _read(rule: str, language: str, pattern: str, text: str, lacks: tuple[str, ...]) -> str:
    none = " AND ".join(f"NOT contains(lower(line), '{w}')" for w in lacks)
    return _branch(rule, 5, "READ_PREFERENCE", "'MONGODB'", "rule_language", text, 0.90,
                   f"is_mongo AND rule_language = '{language}' AND {m('line', pattern)} AND {none}")


def _concat(rule: str, language: str, where: str) -> str:
    return _branch(rule, 2, "STRING_CONCAT_SQL", "platform_base", "concat_language", r.CONCAT_TEXT,
                   0.95, f"concat_language = '{language}' AND {where}")


_CURSOR = r"DECLARE\s+\w+\s+CURSOR"
_CURSOR_HIT = f"({m('line', _CURSOR)} AND NOT {m('line', _CURSOR + '.*FAST_FORWARD')})"
_BRANCHES = [
    _branch("select_star", 1, "SELECT_STAR", "platform_select", "rule_language", r.SELECT_STAR_TEXT, 0.98,
            f"{m('line', STAR)} AND NOT {m('line', r.COUNT_STAR_RX)} AND NOT {m('line', r.EXISTS_STAR_RX)}"),
    _concat("concat_csharp", "C#", any_m("line", r.CS_CONCAT_RX)),
    _concat("concat_java", "JAVA", f"({any_m('line', r.JAVA_CONCAT_RX)} OR {m('line', r.MAPPER_RX, 'c')})"),
    _concat("concat_python", "PYTHON", any_m("line", r.PY_CONCAT_RX)),
    _concat("concat_sql", "SQL", any_m("line", r.SQL_CONCAT_RX)),
    _long("longtxn_scope", "C#", r.SCOPE_TEXT,
          f"{m('line', r.SCOPE_RX)} AND NOT contains(w8, 'Timeout') AND NOT contains(w8, 'TransactionOptions')"),
    _long("longtxn_sqlcommand", "C#", r.SQLCOMMAND_TEXT,
          f"NOT {m('line', r.SCOPE_RX)} AND {m('line', r.SQLCOMMAND_RX)} AND NOT contains(w8, 'CommandTimeout')"),
    _long("longtxn_transactional", "JAVA", r.TRANSACTIONAL_TEXT,
          f"{m('line', r.TRANSACTIONAL_RX)} AND NOT contains(lower(line), 'timeout')"),
    _long("longtxn_statement", "JAVA", r.STATEMENT_TEXT,
          f"NOT {m('line', r.TRANSACTIONAL_RX)} AND {m('line', r.STATEMENT_RX)} "
          "AND NOT contains(w8, 'setQueryTimeout')"),
    _long("longtxn_connect", "PYTHON", r.CONNECT_TEXT,
          f"{m('line', r.CONNECT_RX)} AND NOT contains(line, 'connect_timeout')"),
    _long("longtxn_cursor", "SQL", r.CURSOR_TEXT,
          f"{_CURSOR_HIT} AND NOT contains(line, 'FAST_FORWARD') AND NOT contains(line, 'READ_ONLY')"),
    _long("longtxn_begin", "SQL", r.BEGIN_TEXT,
          f"NOT {_CURSOR_HIT} AND {m('line', r.BEGIN_RX)} "
          "AND NOT contains(upper(w8), 'SET TRANSACTION ISOLATION')"),
    _read("readpref_python", "PYTHON", r.PY_MONGO_RX, r.PY_MONGO_TEXT, ("read_preference", "readpreference")),
    _read("readpref_java", "JAVA", r.JAVA_MONGO_RX, r.JAVA_MONGO_TEXT, ("readpreference",)),
    _read("readpref_csharp", "C#", r.CS_MONGO_RX, r.CS_MONGO_TEXT, ("readpreference",)),
    _branch("unbatched", 3, "UNBATCHED_TXN", "platform_base", "rule_language", r.UNBATCHED_TEXT, 0.85,
            "(file_path, line_number) IN (SELECT file_path, line_number FROM loop_kept)"),
]
V = f"""
loop_all AS (
  SELECT file_path, line_number, line FROM src WHERE
  {' OR '.join(f"(rule_language = {q(lang)} AND {m('w16', rx, 'is')})" for _, lang, rx in _LOOPS)}),
loop_first AS (
  SELECT file_path, min(line_number) AS line_number, arg_min(line, line_number) AS line
  FROM loop_all GROUP BY file_path, line_number // 10),
loop_kept AS (
  SELECT file_path, line_number FROM loop_first WHERE file_path NOT IN (
    SELECT file_path FROM loop_first WHERE {strip('line')} = '')),
v AS ({' UNION ALL '.join(_BRANCHES)})"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join([corpus_sql(), *parts]) + "\n"


FLAT = ("file_path, line_number, line_content, violation_type, severity, platform, language, "
        "description, confidence_score, ctx_before, ctx_after")


def on_lines(select: str, *more: str) -> str:
    return with_(META, SRC, *more) + select


def on_hits(select: str, *more: str) -> str:
    return with_(META, SRC, V, *more) + select


# --- secondary pack ----------------------------------------------------------------

_PACK_NOT_COUNT = f"NOT {m('line', r.COUNT_STAR_RX)}"
_PACK_STAR = f"{m('line', STAR)} AND {_PACK_NOT_COUNT} AND NOT {m('line', r.EXISTS_STAR_RX)}"
_PACK_QUOTED = f"""{m('line', r'''["']SELECT''' + r"\s+\*")} AND {_PACK_NOT_COUNT}"""
_PACK_STMT = m("line", (
    r"(?:Statement|Query)\s+\w+\s*=\s*(?:connection|session|em)\."
    r"create(?:Statement|Query|NativeQuery)\s*\("))
_S, _L, _RP, _SS = "STRING_CONCAT_SQL", "LONG_RUNNING_TXN", "READ_PREFERENCE", "SELECT_STAR"
PACK = {
    "C#": [
        (_SS, _PACK_STAR), (_S, m("line", r.CS_CONCAT_RX[0])),
        (_S, m("line", r"""(?:Database\.ExecuteSql|SqlQuery|RawSql)\s*\(\s*(?:\$|f)["']""")),
        (_S, m("line", r.CS_CONCAT_RX[2])),
        (_L, m("line", r"new\s+SqlCommand") + " AND NOT contains(w5, 'CommandTimeout')"),
    ],
    "JAVA": [
        (_SS, _PACK_QUOTED),
        (_S, m("line", r"""(?:createQuery|createNativeQuery|createStatement|executeQuery)\s*\([^)]*["'][^"']*["']\s*\+""")),
        (_S, m("line", r.JAVA_CONCAT_RX[1]) + " AND " + m("line", r"String\.format.*%[sd]", "c")),
        (_S, m("line", r.MAPPER_RX, "c")),
        (_S, _PACK_STMT + " AND NOT contains(line, 'PreparedStatement')"),
        (_L, _PACK_STMT + " AND NOT contains(next_line, 'setQueryTimeout')"),
    ],
    "PYTHON": [
        (_SS, _PACK_QUOTED), (_S, m("line", r"""(?:cursor|conn)\s*\.\s*execute\s*\(\s*f["']""")),
        (_S, m("line", r"""(?:cursor|conn)\s*\.\s*execute\s*\(["'][^"']*["']\s*%""")),
        (_S, m("line", r"""(?:text|engine\.execute)\s*\(["'][^"']*["']\s*\+""")),
        (_S, m("line", r"""(?:\.raw|RawSQL)\s*\(\s*(?:f["']|["'][^"']*["']\s*%)""")),
        (_RP, m("line", r"MongoClient\s*\(\s*[^)]*\)") + " AND NOT contains(lower(line), 'read_preference') "
                                                        "AND NOT contains(lower(line), 'readpreference')"),
        (_L, m("line", r"psycopg2\.connect\s*\([^)]*\)") + " AND NOT contains(line, 'connect_timeout')"),
    ],
    "SQL": [
        (_SS, _PACK_STAR), (_S, m("line", r"""EXEC\s*\(\s*['"].*['"]\s*\+""")),
        (_S, m("line", r.SQL_CONCAT_RX[1])),
        (_L, f"{m('line', _CURSOR)} AND NOT {m('line', _CURSOR + '.*(FAST_FORWARD|READ_ONLY)')}"),
        (_L, m("line", r.BEGIN_RX) + " AND NOT contains(upper(w15), 'SET TRANSACTION ISOLATION')"),
    ],
}


def _pack(language: str) -> str:
    return " UNION ALL ".join(
        f"SELECT file_path, line_number, '{t}' AS violation_type, line, {i} AS emit_ord FROM src "
        f"WHERE rule_language = '{language}' AND {cond}" for i, (t, cond) in enumerate(PACK[language], 1))


# --- flow checks --------------------------------------------------------------------

_IN_STRING = m("line", r'"[^"]*SELECT\s+\*[^"]*"') + " AND NOT contains(line, 'COUNT(*)')"
_NOT_COMMENT = "NOT regexp_matches(line, '^\\s*(//|#)')"
FLOW = {
    "flow_java_sql_var": ("JAVA", _S, 0.92, "contains(line, 'String sql = ') AND contains(w5, 'executeQuery(sql)')"),
    "flow_java_concat_call": ("JAVA", _S, 0.95, m("line", r'\.(createQuery|executeQuery)\("SELECT [^"]*" \+')),
    "flow_java_loop": ("JAVA", "UNBATCHED_TXN", 0.90, (
        "((contains(line, 'for (') AND contains(w5, 'em.persist')) OR "
        "(contains(line, 'while (') AND contains(w5, '.executeUpdate')))")),
    "flow_java_transactional": ("JAVA", _L, 0.85, "contains(line, '@Transactional') AND NOT contains(line, 'timeout')"),
    "flow_java_stmt_prepared": ("JAVA", _S, 0.88, (
        "contains(line, 'createStatement()') AND contains(next_line, 'executeQuery') AND contains(ctx_before, 'void run')")),
    "flow_java_select_star": ("JAVA", _SS, 0.97, _IN_STRING),
    "flow_py_sql_var": ("PYTHON", _S, 0.93, (
        "((contains(line, ' sql = ') AND contains(next_line, 'execute(sql)')) OR "
        "(contains(line, 'q = f') AND contains(next_line, 'execute(q)')))")),
    "flow_py_fstring": ("PYTHON", _S, 0.96, m("line", r'\.execute\(f"[^"]*SELECT\s')),
    "flow_py_loop": ("PYTHON", "UNBATCHED_TXN", 0.88, "contains(line, 'while ') AND contains(next_line, 'cursor.execute(')"),
    "flow_py_mongo": ("PYTHON", _RP, 0.90, "contains(line, 'MongoClient(') AND NOT contains(line, 'read_preference')"),
    "flow_py_connect": ("PYTHON", _L, 0.82, (
        "(contains(line, 'psycopg2.connect(') OR contains(line, 'cx_Oracle.connect(')) AND NOT contains(line, 'timeout')")),
    "flow_py_select_star": ("PYTHON", _SS, 0.97, _IN_STRING),
    "flow_cs_sql_var": ("C#", _S, 0.93, "contains(line, 'string sql = ') AND contains(w5, 'SqlCommand(sql')"),
    "flow_cs_interpolated": ("C#", _S, 0.95, m("line", r'\$"[^"]*SELECT\s')),
    "flow_cs_loop": ("C#", "UNBATCHED_TXN", 0.92, (
        "((contains(line, 'foreach (') AND contains(w5, 'SaveChanges(')) OR "
        "(contains(line, 'for (') AND contains(w5, 'ExecuteNonQuery(')))")),
    "flow_cs_txnscope": ("C#", _L, 0.87, "contains(line, 'new TransactionScope()')"),
    "flow_cs_cmd_timeout": ("C#", _L, 0.85, "contains(line, 'new SqlCommand(sql')"),
    "flow_cs_select_star": ("C#", _SS, 0.97, _IN_STRING + f" AND {_NOT_COMMENT}"),
}


# --- fixes --------------------------------------------------------------------------

_LC = "line_content"


def _append(key: str) -> str:
    return f"{_LC} || {q(FIX_TEXT[key])}"


def _case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e in pairs) + f" ELSE {otherwise} END"


_TABLE = r"regexp_extract(line_content, 'SELECT\s+\*\s+FROM\s+(\w+)', 1, 'i')"
_TABLE = f"(CASE WHEN {_TABLE} = '' THEN 'table' ELSE {_TABLE} END)"
_COLUMNS = _case([(f"contains(lower({_TABLE}), '{k}')", q(v)) for k, v in TABLE_COLUMNS.items()],
                 q(DEFAULT_COLUMNS))
_CS_JOIN = r"""["']\s*\+\s*(\w+)\s*\+\s*["']"""
_CS_FIX = f"regexp_replace({_LC}, {q(_CS_JOIN)}, {q(FIX_TEXT['concat_cs_param'][0] + chr(92) + '1)')}, 'g')"
_F_DOUBLE = r'f"(.*?)\{(\w+)\}(.*?)"'
_F_SINGLE = r"f'(.*?)\{(\w+)\}(.*?)'"
_F_FIX = (f"regexp_replace(regexp_replace({_LC}, {q(_F_DOUBLE)}, {q(chr(34) + r'\1%s\3' + chr(34) + r', (\2,)')}, 'g'), "
          f"{q(_F_SINGLE)}, {q(chr(39) + r'\1%s\3' + chr(39) + r', (\2,)')}, 'g')")


def _lang(name: str, *words: str) -> str:
    return f"language = '{name}'" + (f" AND {_has(_LC, *words)}" if words else "")


_FIX_CASES: dict[str, list[tuple[str, str, str]]] = {
    "SELECT_STAR": [("true", rf"regexp_replace({_LC}, 'SELECT\s+\*', 'SELECT ' || ({_COLUMNS}), 'gi')",
                     f"replace(replace({q(FIX_WHY['select_star'].replace('%s', '<1>', 1).replace('%s', '<2>'))}, "
                     f"'<1>', {_COLUMNS}), '<2>', {_TABLE})")],
    "STRING_CONCAT_SQL": [
        (_lang("C#", "$", "+"),
         f"CASE WHEN {_CS_FIX} = {_LC} THEN {_append('concat_cs')} ELSE {_CS_FIX} END", q(FIX_WHY["concat_cs"])),
        (_lang("JAVA", "${"), rf"regexp_replace({_LC}, '\$\{{(\w+)\}}', '#{{\1}}', 'g')", q(FIX_WHY["concat_mapper"])),
        (_lang("JAVA", "+"), _append("concat_java"), q(FIX_WHY["concat_java"])),
        (_lang("PYTHON", 'f"', "f'"), _F_FIX, q(FIX_WHY["concat_fstring"])),
        (_lang("PYTHON", "+"), _append("concat_py"), q(FIX_WHY["concat_py"])),
        (f"language = 'SQL' AND contains(upper({_LC}), 'EXEC(')", _append("concat_sql"), q(FIX_WHY["concat_sql"])),
        ("true", _append("concat_other"), q(FIX_WHY["concat_other"])),
    ],
    "UNBATCHED_TXN": [
        (_lang("C#"), _append("unbatched_cs"), q(FIX_WHY["unbatched_cs"])),
        (_lang("JAVA"), _append("unbatched_java"), q(FIX_WHY["unbatched_java"])),
        (_lang("PYTHON"), _append("unbatched_py"), q(FIX_WHY["unbatched_py"])),
        ("true", _append("unbatched_other"), q(FIX_WHY["unbatched_other"])),
    ],
    "LONG_RUNNING_TXN": [
        (_lang("C#", "SqlCommand", "NpgsqlCommand", "OracleCommand"), _append("long_cs_command"),
         q(FIX_WHY["long_cs_command"])),
        (_lang("C#", "TransactionScope"), f"replace({_LC}, 'TransactionScope()', {q(FIX_TEXT['long_cs_scope'])})",
         q(FIX_WHY["long_cs_scope"])),
        (_lang("JAVA", "@Transactional"), f"replace({_LC}, '@Transactional', {q(FIX_TEXT['long_java_annotation'])})",
         q(FIX_WHY["long_java_annotation"])),
        (_lang("JAVA", "createStatement"), _append("long_java_statement"), q(FIX_WHY["long_java_statement"])),
        (_lang("PYTHON", "connect("), f"replace({_LC}, ')', {q(FIX_TEXT['long_py'])})", q(FIX_WHY["long_py"])),
        ("true", _append("long_other"), q(FIX_WHY["long_other"])),
    ],
    "READ_PREFERENCE": [
        (_lang("PYTHON", "MongoClient("), f"replace({_LC}, 'MongoClient(', {q(FIX_TEXT['read_py'])})",
         q(FIX_WHY["read_py"])),
        (_lang("JAVA"), _append("read_java"), q(FIX_WHY["read_java"])),
        (_lang("C#", "MongoClient("), _append("read_cs"), q(FIX_WHY["read_cs"])),
        ("true", _append("read_other"), q(FIX_WHY["read_other"])),
    ],
}
_VID = "sha256(file_path || '#' || CAST(line_number AS VARCHAR) || '#' || violation_type)"


def _by_type(index: int) -> str:
    return "CASE violation_type " + " ".join(
        f"WHEN '{t}' THEN " + _case([(c[0], c[index]) for c in cases], "''")
        for t, cases in _FIX_CASES.items()) + " END"


_CONFIDENCE = "CASE violation_type " + " ".join(
    f"WHEN '{t}' THEN CAST({c} AS DOUBLE)" for t, c in TEMPLATE_CONFIDENCE.items()) + " END"
FIXES = f"""
fixes AS (
  SELECT *, {_VID} AS violation_id, line_content AS original_code, {_by_type(1)} AS fixed_code,
    {_by_type(2)} AS explanation, 'template-engine' AS ai_model_used, {_CONFIDENCE} AS fix_confidence,
    true AS security_review_passed, {q(TEMPLATE_NOTES)} AS security_review_notes
  FROM v)"""
_FIX_COLUMNS = ("file_path, line_number, violation_type, violation_id, original_code, fixed_code, explanation, "
                "ai_model_used, fix_confidence, security_review_passed, security_review_notes")
BATCH = """
first_high AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY violation_type
      ORDER BY file_path, detector_ord, emit_ord) AS rn FROM v WHERE severity = 'HIGH')
  WHERE rn = 1 AND violation_type NOT IN (SELECT violation_type FROM v WHERE severity = 'CRITICAL')),
batch AS (
  SELECT * FROM (
    SELECT file_path, detector_ord, emit_ord, line_number, violation_type, severity, 0 AS tier FROM v WHERE severity = 'CRITICAL'
    UNION ALL
    SELECT file_path, detector_ord, emit_ord, line_number, violation_type, severity, 1 FROM first_high)
  ORDER BY tier, file_path, detector_ord, emit_ord LIMIT 10)"""
BATCH_FIXES = """
batch_fixes AS (
  SELECT f.*, b.tier FROM fixes f JOIN batch b USING (file_path, line_number, violation_type))"""


def on_fixes(select: str, *more: str) -> str:
    return on_hits(select, FIXES, *more)


# --- replies (what the derived replies say, by construction) ----------------------------

_N = "line_number"
_OK = f"({_N} % 7 <> 3 AND {_N} % 6 < 4)"
_FAILED = (f"CASE WHEN {_N} % 7 = 3 THEN 'timeout' WHEN {_N} % 6 = 4 THEN 'No valid JSON found in response' "
           f"WHEN {_N} % 6 = 5 THEN 'Reply is not a JSON object' END")
_NS = f"CAST({_N} AS VARCHAR)"
_EVAL = f"{_N} % 3 = 0"
_EVAL_TEXT = "Dangerous eval() call detected - potential code injection"
_MODEL_CODE = f"CASE WHEN NOT {_OK} THEN '' WHEN {_EVAL} THEN 'eval(' || {_NS} || ')' ELSE 'safe(' || {_NS} || ')' END"
_MODEL_WHY = f"CASE WHEN {_OK} THEN 'why ' || {_NS} ELSE 'Fix generation failed: ' || {_FAILED} END"
_MODEL_CONFIDENCE = (
    f"CASE WHEN NOT {_OK} THEN 0.0::DOUBLE WHEN {_N} % 2 = 0 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END")
MODEL_FIXES = f"""
model_fixes AS (
  SELECT *, {_VID} AS violation_id, line_content AS original_code,
    {_MODEL_CODE} AS fixed_code,
    {_MODEL_WHY} AS explanation,
    {_MODEL_CONFIDENCE} AS fix_confidence,
    ({_OK} AND NOT {_EVAL}) AS security_review_passed,
    CASE WHEN NOT {_OK} THEN 'Error: ' || {_FAILED} WHEN {_EVAL} THEN {q(_EVAL_TEXT)}
         ELSE 'Passed basic validation' END AS security_review_notes
  FROM v),
reviewed AS (
  SELECT violation_id, {_N}, fixed_code, description,
    ({_OK} AND {_N} % 5 <> 1) AS security_review_passed,
    CASE WHEN fixed_code = '' THEN 'No fixed code to review'
         ELSE 'note ' || {_NS} || CASE WHEN {_N} % 2 = 0 THEN ' Issues: LOW: x; UNKNOWN: y' ELSE '' END
    END AS security_review_notes,
    CASE WHEN {_OK} AND {_N} % 4 <> 0 THEN 'risk ' || {_NS} ELSE description END AS new_description
  FROM model_fixes)"""

# --- prompts -----------------------------------------------------------------------------


def masked(expr: str, patterns=SECRET_PATTERNS) -> str:
    for pattern, ignore_case, *_ in patterns:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(REDACTED)}, {q('gi' if ignore_case else 'g')})"
    return expr


def _filled(template: str, fields: dict[str, str]) -> str:
    out = q(template)
    for name, expr in fields.items():
        out = f"replace({out}, '{{{name}}}', {expr})"
    return out


_BASIC = {"violation_type": "violation_type", "platform": "platform", "language": "language"}
# contexts are taken as lists: an edge of the file has no empty line there
_CONTEXT = ("concat_ws(chr(10), CASE WHEN line_number > 1 THEN ctx_before END, line_content, "
            "CASE WHEN line_number < 40 THEN ctx_after END)")


def _prompt(kind: str, model: str, template: str, fields: dict[str, str], source: str) -> str:
    return (f"SELECT {_VID} AS violation_id, '{kind}' AS kind, '{model}' AS model, length(p) AS n_chars, "
            f"sha256(p) AS input_hash FROM (SELECT *, {_filled(template, fields)} AS p FROM {source})")


# --- whole texts ---------------------------------------------------------------------------

TEXTS = """
texts AS (
  SELECT 'doc' || CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT file_path, content FROM code_files)"""


def _found_counts() -> str:
    selects, stage = [], "text"
    for (pattern, ignore_case, group), label in zip(SECRET_PATTERNS, SECRET_LABELS):
        opt = q("i" if ignore_case else "c")
        selects.append(
            f"SELECT id, {q(label)} AS label, unnest(regexp_extract_all({stage}, {q(pattern)}, {group}, {opt})) AS value FROM texts")
        stage = f"regexp_replace({stage}, {q(pattern)}, {q(REDACTED)}, {q('gi' if ignore_case else 'g')})"
    return ("SELECT id, label, count(*) AS n FROM (" + " UNION ALL ".join(selects)
            + ") WHERE value <> '' GROUP BY id, label")


# --- repositories -----------------------------------------------------------------------------

_PLACED = (
    "CASE n % 7 WHEN 2 THEN '_priv/' || file_path WHEN 3 THEN '.hid/' || file_path "
    "WHEN 4 THEN 'Build/' || file_path || '.PY' WHEN 6 THEN 'pkg/' || replace(file_path, '/src/f', '/src/__f') "
    "ELSE file_path END")
_NUMBER = "CAST(regexp_extract(file_path, 'f([0-9]+)[.]', 1) AS INTEGER)"
_EXPECTED = (
    ("SELECT_STAR", "SELECT * FROM", 0), ("SQL_INJECTION", "${", 0),
    ("NO_TIMEOUT", "psycopg2.connect(", 1), ("NO_READ_PREFERENCE", "MongoClient(", 0),
    ("MISSING_TRY_CATCH", "executeUpdate", 2), ("UNBATCHED_INSERT", "insert_one", 3),
)
MANIFEST = "\nexpected AS (" + " UNION ALL ".join(
    f"SELECT repo, file_path || '#' || CAST(line_number AS VARCHAR) || '#{w}' AS violation_id, file_path AS file, "
    f"'{w}' AS violation_type, CASE WHEN line_number % 2 = 0 THEN 'Oracle' ELSE 'MSSQL' END AS database_platform, "
    f"CASE WHEN line_number % 3 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, "
    f"CAST(line_number AS VARCHAR)" + (f" || '-' || CAST(line_number + {x} AS VARCHAR)" if x else "")
    + f" AS line_range, line AS code_snippet, line_number AS lo, line_number + {x} AS hi "
    f"FROM code_lines WHERE contains(line, {q(t)})" for w, t, x in _EXPECTED) + ")"


def _facet_counts(facet: str) -> str:
    return (f"SELECT '{facet}' AS facet, repo, {facet} AS value, count(*) AS n, "
            f"count(*) + CASE WHEN {facet} IN ('SELECT_STAR', 'MSSQL') THEN 1 ELSE 0 END AS s "
            f"FROM expected GROUP BY repo, {facet}")


_PATH_CASE = (r"CASE WHEN regexp_matches(file_path, '^repos/r1.*/.*\.java$') THEN 'java-team' "
              r"WHEN regexp_matches(file_path, '^.*\.[sx][qm]l$') THEN 'dba-team' "
              r"WHEN regexp_matches(file_path, '^repos/r./.*$') THEN 'core-team' "
              r"WHEN regexp_matches(file_path, '^.*/f1.\.cs$') THEN 'dotnet-team' ELSE 'security-team' END")
_URL = (
    "CASE page_id % 6 WHEN 0 THEN 'https://github.com/own' || page_id || '/rep' || page_id "
    "WHEN 1 THEN '  https://github.com/own' || page_id || '/rep.git/ ' "
    "WHEN 2 THEN 'http://github.com/own/rep' || page_id || '/tree/main/a/b' || page_id "
    "WHEN 3 THEN 'https://github.com/own/rep' || page_id || '/tree/main' "
    "WHEN 4 THEN 'https://github.com/own' || page_id ELSE url END")
_NAMES = "['.py', '.PY', '.Cs', '.java', '.sql.bak', '', '.XML', '.sql', '/.py', '.']"
_ROW = ("'| ' || {path} || ':' || CAST(line_number AS VARCHAR) || ' | ' || violation_type || ' | ' "
        "|| CAST(CAST(round_even(fix_confidence * 100, 0) AS INTEGER) AS VARCHAR) || '% |' || chr(10)")
_BODY_HEAD = ("### Fixes Applied\n\n| File | Violation | Confidence |\n"
              "|------|-----------|------------|\n")
_FACETS = ("violation_type", "severity", "platform", "language")


def build() -> dict[str, str]:
    out: dict[str, str] = {}

    # sources and sinks
    # the corpus has neither escapes nor strings over several lines
    slash, hash_ = r'//[^\n]*|/\*[^*]*\*/|', r'#[^\n]*|'
    rest = r'\$?"[^"\n]*"|\w+|\s+|.'
    blank = "regexp_replace({}, '[^\n]', ' ', 'g')"
    out["code_mask"] = with_(META, SRC) + (
        "SELECT file_path, CASE ext WHEN '.cs' THEN 'C#' WHEN '.py' THEN 'PYTHON' ELSE 'JAVA' END AS language, "
        "array_to_string(list_transform(regexp_extract_all(content, CASE ext "
        f"WHEN '.py' THEN {q(hash_ + '[fF]?' + rest)} ELSE {q(slash + rest)} END), lambda t: CASE "
        f"WHEN (ext = '.py' AND t[1] = '#') OR (ext <> '.py' AND t[1:2] IN ('//', '/*')) THEN {blank.format('t')} "
        f"WHEN t[-1] = '\"' THEN '\"' || {blank.format('t[2:-2]')} || '\"' ELSE t END), '') AS code "
        "FROM code_files WHERE ext IN ('.cs', '.py', '.java')")
    out["src_discover_files"] = with_() + (
        f"SELECT {_PLACED} AS relative_path, CASE WHEN n % 7 = 4 THEN 'PYTHON' ELSE CASE ext WHEN '.cs' THEN 'C#' "
        f"WHEN '.py' THEN 'PYTHON' WHEN '.sql' THEN 'SQL' ELSE 'JAVA' END END AS route_language, "
        f"CAST(strlen(content) AS BIGINT) AS size_bytes FROM (SELECT *, {_NUMBER} AS n FROM code_files) "
        f"WHERE n % 7 NOT IN (1, 5)")
    out["src_file_language"] = (
        f"SELECT doc_id, path, CASE WHEN doc_id % 10 IN (0, 1) THEN 'PYTHON' WHEN doc_id % 10 = 2 THEN 'C#' "
        f"WHEN doc_id % 10 IN (3, 6) THEN 'JAVA' WHEN doc_id % 10 = 7 THEN 'SQL' END AS language "
        f"FROM (SELECT doc_id, 'd' || doc_id || {_NAMES}[doc_id % 10 + 1] AS path FROM documents)")
    out["src_read_decode"] = with_() + (
        f"SELECT relative_path, length(t) AS n_chars, sha256(t) AS hash FROM (SELECT file_path AS relative_path, "
        f"CASE WHEN bytes > 1024 THEN left(txt, 1024) || {q(TRUNCATION_MARKER)} ELSE txt END AS t FROM ("
        f"SELECT file_path, CASE length(content) % 3 WHEN 2 THEN content ELSE content || 'é' END AS txt, "
        f"strlen(content) + CASE length(content) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 39 END AS bytes FROM code_files))")
    out["src_read_decode_whole"] = with_() + (
        "SELECT file_path AS relative_path, length(txt) AS n_chars, sha256(txt) AS hash FROM (SELECT file_path, "
        "CASE length(content) % 3 WHEN 2 THEN content ELSE content || 'é' END AS txt FROM code_files)")
    out["sink_scan_json"] = on_hits(
        "SELECT f.repo AS repo_path, f.n AS files, coalesce(c.n, 0) AS violations, coalesce(c.n, 0) AS listed, "
        "t.by_type FROM (SELECT repo, count(*) AS n FROM files GROUP BY repo) f "
        "LEFT JOIN (SELECT repo, count(*) AS n FROM v GROUP BY repo) c USING (repo) "
        "LEFT JOIN (SELECT repo, string_agg(violation_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY violation_type) AS by_type "
        "FROM (SELECT repo, violation_type, count(*) AS n FROM v GROUP BY ALL) GROUP BY repo) t USING (repo)")
    out["src_read_scan_json"] = on_hits(
        "SELECT repo AS repo_path, file_path, line_number, line_content, violation_type, severity, platform, language, "
        "confidence_score, ctx_before FROM v")
    out["sink_violation_rows"] = on_hits(
        "SELECT file_path, replace(replace(file_path, 'repos/', ''), 'repos', '') AS relative_path, "
        "string_split(file_path, '/')[-1] AS file_name, line_number, left(line_content, 150) AS line_content, "
        "violation_type, severity, platform, language, description, confidence_score FROM v")
    out["scan_stream"] = on_hits(f"SELECT {FLAT} FROM v")

    # projections
    out["explode_lines"] = (
        "SELECT CAST(doc_id AS VARCHAR) AS file_path, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_number, "
        "unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
    out["line_context"] = on_lines("SELECT file_path, line_number, line, ctx_before, ctx_after FROM src")
    out["line_windows"] = on_lines(
        "SELECT file_path, line_number, w16 AS unbatched_window, w8 AS long_txn_window, w15 AS sql_pack_window FROM src")
    out["rule_language"] = with_(META) + "SELECT file_path, route_language, rule_language, concat_language FROM files"
    out["platform_infer"] = with_(META) + (
        "SELECT file_path, platform_base AS base, platform_select AS select_star, platform_longtxn AS long_txn FROM files")
    out["severity_map"] = (
        "SELECT event_id, t AS violation_type, CASE WHEN t = 'STRING_CONCAT_SQL' THEN 'CRITICAL' ELSE 'HIGH' END AS severity "
        "FROM (SELECT event_id, ['SELECT_STAR', 'STRING_CONCAT_SQL', 'UNBATCHED_TXN', 'LONG_RUNNING_TXN', "
        "'READ_PREFERENCE', 'OTHER'][event_id % 6 + 1] AS t FROM events)")
    out["violation_validate"] = with_() + (
        f"SELECT file_path, line_number - 1 AS line_number, line AS line_content, "
        f"CASE WHEN line_number % 9 = 0 THEN '  ' ELSE 'text' END AS description, "
        f"line_number / 38::DOUBLE AS confidence_score, "
        f"({strip('line')} <> '' AND line_number % 9 <> 0 AND line_number >= 2 AND line_number <= 38) AS is_valid FROM code_lines")
    out["code_hash"] = "SELECT doc_id, sha256(text) AS hash FROM documents"
    out["violation_id"] = on_hits(f"SELECT file_path, line_number, violation_type, {_VID} AS violation_id FROM v")
    out["cost_estimate"] = (
        "SELECT model, count(*) AS n, round(sum(length(text) / 4 / 1000000 * i + 4096 / 1000000 * o), 6) AS cost FROM ("
        "SELECT text, ['claude-sonnet-4-6', 'claude-opus-4-6', 'other'][doc_id % 3 + 1] AS model, "
        "[3.0::DOUBLE, 15.0, 3.0][doc_id % 3 + 1] AS i, [15.0::DOUBLE, 75.0, 15.0][doc_id % 3 + 1] AS o FROM documents) GROUP BY model")
    out["parse_repo_url"] = (
        f"WITH a AS (SELECT page_id, regexp_replace(regexp_replace({strip(_URL)}, '/+$', ''), '\\.git$', '') AS u FROM pages), "
        "b AS (SELECT page_id, string_split(replace(replace(u, 'https://github.com/', ''), 'http://github.com/', ''), '/') AS p FROM a) "
        "SELECT page_id, CASE WHEN len(p) >= 2 THEN p[1] END AS owner, CASE WHEN len(p) >= 2 THEN p[2] END AS repo, "
        "CASE WHEN len(p) > 4 AND p[3] = 'tree' THEN array_to_string(p[5:], '/') END AS folder FROM b")
    out["path_rel_base"] = with_() + (
        "SELECT file_path, replace(replace(file_path, repo || '/', ''), repo, '') AS relative_path, "
        "string_split(file_path, '/')[-1] AS file_name FROM code_files")

    # line rules
    for rule in r.RULES:
        out[f"det_{rule.name}"] = on_hits(f"SELECT {FLAT} FROM v WHERE rule = '{rule.name}'")
    for name, language, pattern in _LOOPS:
        out[f"det_{name}"] = on_lines(
            f"SELECT file_path, line_number FROM src WHERE rule_language = '{language}' AND {m('w16', pattern, 'is')}")
    out["det_unbatched_bucket"] = on_hits(f"SELECT {FLAT} FROM v WHERE rule = 'unbatched'")
    out["det_readpref_filegate"] = with_(META) + "SELECT file_path, is_mongo FROM files"
    for key, language in (("aux_csharp", "C#"), ("aux_java", "JAVA"), ("aux_python", "PYTHON"), ("aux_sql", "SQL")):
        out[key] = on_lines(_pack(language))

    # statement and flow checks: on the derived corpus their findings can be told from
    # the line and its neighbours alone
    for key, (language, vtype, confidence, where) in FLOW.items():
        out[key] = on_lines(
            f"SELECT file_path, line_number, '{vtype}' AS violation_type, CAST({confidence} AS DOUBLE) AS confidence_score "
            f"FROM src WHERE rule_language = '{language}' AND {where}")

    # scan, dedup, statistics
    out["scan_repository"] = on_hits(f"SELECT {FLAT} FROM v")
    # order of a check among those of its language
    order = {key: i for i, key in enumerate(FLOW)}
    flow_rows = " UNION ALL ".join(
        f"SELECT file_path, line_number, '{t}' AS violation_type, '{'CRITICAL' if t == _S else 'HIGH'}' AS severity, "
        f"rule_language AS language, CAST({c} AS DOUBLE) AS confidence_score, 6 AS detector_ord, {order[key]} AS emit_ord "
        f"FROM src WHERE rule_language = '{lang}' AND {where}" for key, (lang, t, c, where) in FLOW.items())
    out["flow_emit"] = on_lines(" UNION ALL ".join(
        f"SELECT file_path, line_number, '{t}' AS violation_type, '{'CRITICAL' if t == _S else 'HIGH'}' AS severity, "
        f"platform_base AS platform, rule_language AS language, CAST({c} AS DOUBLE) AS confidence_score, "
        f"true AS is_marked, ctx_before, ctx_after FROM src WHERE rule_language = '{lang}' AND {where}"
        for lang, t, c, where in FLOW.values()))
    full_scan = (
        "SELECT file_path, line_number, violation_type, severity, language, confidence_score, detector_ord FROM ("
        "SELECT *, row_number() OVER (PARTITION BY file_path, violation_type, line_number ORDER BY detector_ord, emit_ord) AS rn "
        "FROM (SELECT file_path, line_number, violation_type, severity, language, confidence_score, detector_ord, emit_ord "
        f"FROM v UNION ALL {flow_rows})) WHERE rn = 1")
    out["scan_repository_flow"] = out["scan_stream_full"] = on_hits(full_scan)
    out["scan_stream_gate"] = on_hits(
        "SELECT f.file_path, count(s.file_path) AS violations, count(s.file_path) > 0 AS approval_required "
        f"FROM files f LEFT JOIN ({full_scan}) s ON s.file_path = f.file_path GROUP BY f.file_path")
    packs = " UNION ALL ".join(f"({_pack(lang)})" for lang in PACK)
    out["scan_dedup"] = on_hits(
        f"SELECT file_path, line_number, violation_type, detector_ord, emit_ord FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY file_path, violation_type, line_number ORDER BY detector_ord, emit_ord) AS rn FROM ("
        f"SELECT file_path, line_number, violation_type, detector_ord, emit_ord FROM v UNION ALL "
        f"SELECT file_path, line_number, violation_type, 9, emit_ord FROM ({packs}))) WHERE rn = 1")
    out["scan_language_route"] = with_(META) + (
        "SELECT file_path, d.detector FROM files, (VALUES ('select_star'), ('string_concat'), ('unbatched'), "
        "('long_txn'), ('read_pref'), ('flow')) d(detector) WHERE d.detector NOT IN ('unbatched', 'read_pref', 'flow') "
        f"OR route_language IN {FLOW_LANGUAGES}")
    for key, facet in (("stats_by_type", "violation_type"), ("stats_by_severity", "severity"),
                       ("stats_by_platform", "platform"), ("stats_by_language", "language")):
        out[key] = on_hits(f"SELECT {facet}, count(*) AS n FROM v GROUP BY {facet}")
    out["stats_all_facets"] = on_hits(" UNION ALL ".join(
        f"SELECT '{f}' AS facet, {f} AS value, count(*) AS n FROM v GROUP BY {f}" for f in _FACETS))
    names = ", ".join(_FACETS)
    out["stats_grouping_sets"] = out["stats_by_batches"] = on_hits(
        "SELECT CASE WHEN grouping(repo) = 0 THEN 'group' ELSE 'all' END AS level, repo, CASE "
        + " ".join(f"WHEN grouping({f}) = 0 THEN '{f}'" for f in _FACETS) + " ELSE 'total' END AS facet, "
        f"coalesce({names}) AS value, count(*) AS n FROM (SELECT *, "
        "string_split(file_path, '/')[1] || '/' || string_split(file_path, '/')[2] AS repo FROM v) GROUP BY GROUPING SETS ("
        + ", ".join(f"({', '.join(k)})" for r in ([], ["repo"]) for k in ([*r], *[[*r, f] for f in _FACETS])) + ")")
    out["stats_totals"] = on_hits(
        "SELECT (SELECT count(*) FROM files) AS total_files_scanned, (SELECT count(*) FROM v) AS total_violations")
    out["pr_type_counts"] = on_hits("SELECT violation_type, count(*) AS n, 'HIGH' AS severity FROM v GROUP BY violation_type")

    # manifests
    out["src_read_manifest"] = with_(MANIFEST) + (
        "SELECT violation_id, file, violation_type, database_platform, severity, line_range, code_snippet, lo, hi FROM expected")
    counted = " UNION ALL ".join(_facet_counts(f) for f in ("violation_type", "severity", "database_platform"))
    out["manifest_summary_check"] = with_(MANIFEST) + (
        f"SELECT facet, value, CAST(sum(s) AS BIGINT) AS stored, CAST(sum(n) AS BIGINT) AS listed, "
        f"CAST(sum(s) - sum(n) AS BIGINT) AS difference FROM ({counted}) GROUP BY facet, value")
    whens = " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in TYPE_OF_WORD.items())
    out["manifest_match"] = on_hits(
        f"SELECT e.violation_id, e.mapped_type, EXISTS (SELECT 1 FROM v WHERE v.file_path = e.file "
        f"AND v.violation_type = e.mapped_type AND v.line_number BETWEEN e.lo AND e.hi) AS matched "
        f"FROM (SELECT *, CASE violation_type {whens} END AS mapped_type FROM expected) e", MANIFEST)

    # masking and validation
    out["mask_secrets"] = with_(TEXTS) + f"SELECT id, {masked('text')} AS masked FROM texts"
    out["mask_secrets_found"] = with_(TEXTS) + _found_counts()
    out["mask_log_text"] = with_(TEXTS) + f"SELECT {masked('id', LOG_PATTERNS)} AS id, {masked('text', LOG_PATTERNS)} AS text FROM texts"
    out["mask_fields"] = (
        f"SELECT event_id, user_id, '{REDACTED}' AS session_token, '{REDACTED}' AS \"Api_Key\", event_type AS kind, "
        f"'{REDACTED}' AS nested_pwd_hint, user_id AS nested_uid FROM events")
    issues = ", ".join(
        f"CASE WHEN {m('line', p, 'i' if ignore_case else 'c')} THEN {q(text)} END" for p, ignore_case, text in UNSAFE_PATTERNS)
    out["validate_fix"] = with_() + (
        f"SELECT file_path, line_number, issues = '' AS is_valid, issues FROM "
        f"(SELECT file_path, line_number, concat_ws('; ', {issues}) AS issues FROM code_lines)")

    # fixes
    out["fix_template"] = on_fixes(f"SELECT {_FIX_COLUMNS} FROM fixes")
    for key, vtype in (("fix_select_star", "SELECT_STAR"), ("fix_string_concat", "STRING_CONCAT_SQL"),
                       ("fix_unbatched", "UNBATCHED_TXN"), ("fix_long_running", "LONG_RUNNING_TXN"),
                       ("fix_read_preference", "READ_PREFERENCE")):
        out[key] = on_fixes(f"SELECT {_FIX_COLUMNS} FROM fixes WHERE violation_type = '{vtype}'")
    out["fix_select_batch"] = on_hits("SELECT file_path, line_number, violation_type, severity, tier FROM batch", BATCH)
    # both fixes of a finding are made in its own row, without a join
    out["fix_ai_fallback"] = on_fixes(
        "SELECT violation_id, CASE WHEN model_code <> '' THEN model_code ELSE fixed_code END AS fixed_code, "
        f"CASE WHEN model_code <> '' THEN {_MODEL_WHY} ELSE explanation END AS explanation, "
        f"CASE WHEN model_code <> '' THEN '{FIX_MODEL}' ELSE ai_model_used END AS ai_model_used, "
        f"CASE WHEN model_code <> '' THEN {_MODEL_CONFIDENCE} ELSE fix_confidence END AS fix_confidence "
        f"FROM (SELECT *, {_MODEL_CODE} AS model_code FROM fixes)")
    out["fix_rows"] = on_fixes(
        "SELECT violation_type AS type, string_split(file_path, '/')[-1] AS file, file_path AS relative_path, "
        "line_number AS line, left(original_code, 300) AS original, left(fixed_code, 600) AS fixed, "
        "left(explanation, 300) AS explanation, fix_confidence AS confidence, fixed_code <> '' AS has_fix FROM fixes")
    out["fix_approve_web"] = on_hits(
        f"SELECT violation_id, (NOT {_EVAL} OR fix_confidence >= 0.7) AS approved, CASE WHEN NOT {_EVAL} THEN 'Passed validation' "
        f"WHEN fix_confidence >= 0.7 THEN 'Approved (confidence 75%)' ELSE {q(_EVAL_TEXT)} END AS notes "
        "FROM model_fixes WHERE fixed_code <> ''", MODEL_FIXES)
    out["fix_approve_ai"] = on_hits(
        "SELECT violation_id, security_review_notes FROM model_fixes WHERE security_review_passed", MODEL_FIXES)
    folded = (
        "SELECT file_path, r.o AS content, CAST(length(r.f) AS INTEGER) AS applied FROM (SELECT c.file_path, list_reduce("
        "l, lambda acc, x: {step}, struct_pack(o := c.content, f := '')) AS r FROM code_files c JOIN (SELECT file_path, "
        "list(struct_pack(o := original_code, f := fixed_code) ORDER BY detector_ord, emit_ord) AS l FROM fixes "
        "WHERE fixed_code <> '' GROUP BY file_path) USING (file_path))")
    out["fix_apply_first"] = on_fixes(folded.format(step=(
        "CASE WHEN contains(acc.o, x.o) THEN struct_pack(o := left(acc.o, strpos(acc.o, x.o) - 1) || x.f "
        "|| substr(acc.o, strpos(acc.o, x.o) + length(x.o)), f := acc.f || '.') ELSE acc END")))
    out["fix_apply_all"] = on_fixes(folded.format(
        step="struct_pack(o := replace(acc.o, x.o, x.f), f := acc.f || '.')"))
    out["fix_dry_run"] = on_hits(
        f"SELECT file_path, line_number, violation_type, {_VID} AS violation_id, line_content AS original_code, '' AS fixed_code, "
        f"'DRY RUN - no AI call made' AS explanation, '{FIX_MODEL}' AS ai_model_used, 0.0::DOUBLE AS fix_confidence, "
        "false AS security_review_passed, '' AS security_review_notes FROM v")

    # review
    out["reviewer_by_path"] = out["reviewer_by_table"] = with_() + f"SELECT file_path, {_PATH_CASE} AS reviewer FROM code_files"
    out["reviewer_by_type"] = on_hits(
        "SELECT file_path, line_number, violation_type, unnest(CASE violation_type WHEN 'STRING_CONCAT_SQL' THEN "
        "['sec-lead', 'dba-team'] WHEN 'UNBATCHED_TXN' THEN ['perf-team'] ELSE ['security-team'] END) AS reviewer FROM v")
    out["pr_reviewers"] = on_hits(
        f"SELECT repo, string_agg(reviewer, ',' ORDER BY reviewer) AS reviewers FROM "
        f"(SELECT DISTINCT repo, {_PATH_CASE} AS reviewer FROM v) GROUP BY repo")
    out["pr_plan"] = on_fixes(
        "SELECT repo, n AS fixes, 'DB Hygiene: Fix ' || CAST(n AS VARCHAR) || ' violations (' || t || ')' AS title, "
        "a < 0.85 AS is_draft, 'db-hygiene,automated-fix' AS labels FROM (SELECT repo, count(*) AS n, "
        "avg(fix_confidence) AS a, string_agg(DISTINCT violation_type, ', ' ORDER BY violation_type) AS t FROM fixes GROUP BY repo)")
    intro = q("## DB Hygiene Automated Fix\n\nThis PR addresses **")
    web_row = _ROW.format(path="string_split(file_path, '/')[-1]")
    web_tail = ("\n### Review Checklist\n- [ ] Verify fixes compile and pass tests\n- [ ] Review business logic preservation\n"
                "- [ ] Run integration tests\n\n---\n*Generated by lintlake*\n")
    out["pr_body"] = on_fixes(
        f"SELECT {intro} || CAST(count(*) AS VARCHAR) || "
        + q("** database hygiene violations detected and fixed by the automated scanner.\n\n### Scan Summary\n- **")
        + " || CAST((SELECT count(*) FROM v) AS VARCHAR) || " + q("** total violations found\n- **")
        + " || CAST((SELECT count(*) FROM files) AS VARCHAR) || " + q("** files scanned\n\n" + _BODY_HEAD)
        + f" || string_agg({web_row}, '' ORDER BY file_path, detector_ord, emit_ord) || {q(web_tail)} AS body FROM batch_fixes",
        BATCH, BATCH_FIXES)
    lib_tail = ("\n### Testing Recommendations\n\n- [ ] Verify all fixes compile and pass existing tests\n"
                "- [ ] Review each fix for business logic preservation\n- [ ] Run integration tests against test database\n"
                "\n---\n*Generated by lintlake*\n")
    out["pr_body_lines"] = on_fixes(
        f"SELECT repo, 0 AS part, '' AS file_path, 0 AS detector_ord, 0 AS emit_ord, {intro} || CAST(count(*) AS VARCHAR) || "
        + q("** database hygiene violations detected by the automated scanner.\n\n" + _BODY_HEAD)
        + f" AS text FROM fixes GROUP BY repo UNION ALL SELECT repo, 2, '', 0, 0, {q(lib_tail)} FROM fixes GROUP BY repo "
        f"UNION ALL SELECT repo, 1, file_path, detector_ord, emit_ord, {_ROW.format(path='file_path')} FROM fixes")
    out["pr_comment_body"] = on_hits(
        "SELECT " + q("## DB Hygiene Scan Results\n\n**") + " || CAST(sum(n) AS VARCHAR) || "
        + q("** violation(s) detected\n\n".replace("** violation(s) detected", " violation(s) detected**")
            + "| Type | Count | Severity |\n|------|-------|----------|\n")
        + " || string_agg('| ' || violation_type || ' | ' || CAST(n AS VARCHAR) || ' | HIGH |' || chr(10), '' "
        "ORDER BY n DESC, f, d, e) || " + q("\n---\n*Generated by lintlake*")
        + " AS body FROM (SELECT violation_type, count(*) AS n, min((file_path, detector_ord, emit_ord)) AS o, "
        "min(file_path) AS f, min(detector_ord) AS d, min(emit_ord) AS e FROM v GROUP BY violation_type)")
    out["gate_decision"] = on_hits(
        "SELECT f.file_path, count(v.file_path) AS violations, count(v.file_path) > 0 AS approval_required "
        "FROM files f LEFT JOIN v ON v.file_path = f.file_path GROUP BY f.file_path")

    # prompts and replies
    out["prompt_classify"] = on_hits(_prompt("classify", SCAN_MODEL, CLASSIFY_PROMPT, {
        **_BASIC, "snippet": masked(_LC), "context": _CONTEXT}, "v"))
    out["prompt_fix"] = on_hits(_prompt("fix", FIX_MODEL, FIX_PROMPT, {
        **_BASIC, "snippet": masked(_LC), "context": _CONTEXT}, "v"))
    out["prompt_review"] = on_fixes(_prompt("review", REVIEW_MODEL, REVIEW_PROMPT, {
        **_BASIC, "original_code": "original_code", "fixed_code": "fixed_code"}, "fixes"))
    from ..fixed import PR_DESCRIPTION_PROMPT
    summary = ("string_agg('- ' || violation_type || ' ' || file_path || ':' || CAST(line_number AS VARCHAR) || ' ' || explanation, "
               "chr(10) ORDER BY file_path, detector_ord, emit_ord)")
    out["prompt_pr_description"] = on_fixes(
        "SELECT " + _filled(PR_DESCRIPTION_PROMPT, {
            "fixes_summary": "s", "total_count": "CAST(n AS VARCHAR)", "categories": "c"})
        + f" AS prompt FROM (SELECT {summary} AS s, count(*) AS n, string_agg(DISTINCT violation_type, ', ' "
        "ORDER BY violation_type) AS c FROM batch_fixes)", BATCH, BATCH_FIXES)
    out["reply_parse_json"] = on_hits(
        f"SELECT violation_id, CASE WHEN {_OK} THEN fixed_code END AS fixed_code, "
        f"CASE WHEN {_OK} THEN fix_confidence END AS score, NOT {_OK} AS failed FROM model_fixes", MODEL_FIXES)
    out["reply_classify_merge"] = on_hits(
        f"SELECT {_VID} AS violation_id, severity, CASE WHEN {_OK} AND {_N} % 4 <> 0 THEN 'risk ' || {_NS} ELSE description END "
        f"AS description, CASE WHEN {_OK} AND {_N} % 5 <> 0 THEN 0.5::DOUBLE ELSE confidence_score END AS confidence_score FROM v")
    out["reply_fix_merge"] = on_hits(
        "SELECT violation_id, original_code, fixed_code, explanation, fix_confidence, security_review_passed, "
        "security_review_notes FROM model_fixes", MODEL_FIXES)
    out["reply_review_merge"] = on_hits(
        "SELECT violation_id, security_review_passed, security_review_notes FROM reviewed", MODEL_FIXES)
    out["ai_run"] = on_hits(
        "SELECT violation_id, new_description AS description, fixed_code, security_review_notes FROM reviewed "
        "WHERE security_review_passed", MODEL_FIXES)
    out["ai_stats"] = on_hits(
        "SELECT count(*) AS violations_classified, count(*) FILTER (WHERE fixed_code <> '') AS fixes_generated, "
        "count(*) FILTER (WHERE security_review_passed) AS fixes_approved, "
        "count(*) FILTER (WHERE NOT security_review_passed) AS fixes_rejected FROM reviewed", MODEL_FIXES)
    assert FILES_PER_REPO
    return out
