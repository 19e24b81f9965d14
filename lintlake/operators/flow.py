"""Statement, scope and data-flow checks: one fold over each file, in the file's own row.

* lexemes: one regular expression per language cuts a file into comments, strings and
  code, so that delimiters inside comments and strings do not count;
* statements: pieces between code-level delimiters, stitched while brackets are open;
* bracket pairs: a running pass over the brackets of a statement gives every bracket its
  level; sorted by level, an opening bracket stands next to its partner.  Calls are found by
  their name before a bracket, receivers by going back through the pairs;
* facts: intervals (a block, a loop, a variable's scope) and point events (a sink, a
  call) on the statement axis.  "Does an event with this key fall into that interval"
  is one running pass over the facts sorted by key.

Everything is an array in the row of its file: nothing is exchanged and files are read once.
Running passes go through short chunks, because appending to an array copies it; sorting takes
the place of grouping.  No pattern recurses, whatever the
length of a chain or the depth of brackets.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    CSHARP, JAVA, LONG_RUNNING_TXN, PYTHON, READ_PREFERENCE, SELECT_STAR, STRING_CONCAT_SQL,
    UNBATCHED_TXN,
)
from ..functions.lang import severity
from ..functions.text import NOCASE, fold_sql, quote, split_lines, strip_sql
from .lines import context_after, context_before
from .rules import COUNT_STAR_RX, FLOW_ORD, SELECT_STAR_RX, contains_any
from .scan import with_file_columns

CUT, MARK = "\u0001", "\u0002"  # end of a piece, end of a bracket; blanks where a file holds them
LANGUAGES = (JAVA, PYTHON, CSHARP)

# --- lexing --------------------------------------------------------------------

_SLASH_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\z)"
_CHARS = r"'(?:[^'\\\n]|\\.)*+'?"
_PLAIN = r'"(?:[^"\\\n]|\\.)*+"?'
_PREFIX = r"(?:[rRbBuUfF]{1,2})?"
LEXERS = {
    JAVA: "(?s)" + "|".join([
        _SLASH_COMMENTS, r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\z)', _PLAIN, _CHARS,
        r"[{};]", r"""[^{};/"']+""", ".",
    ]),
    CSHARP: "(?s)" + "|".join([
        _SLASH_COMMENTS, r'\$*"""(?:[^"]|"(?!""))*+(?:"""|\z)',
        r'(?:\$@|@\$|@)"(?:[^"]|"")*+"?',
        r'\$"(?:[^"\\\n{}]|\\.|\{\{|\}\}|\{[^{}\n]*\}|[{}])*+"?',
        _PLAIN, _CHARS, r"[{};]", r"""[^{};/"'$@]+""", ".",
    ]),
    PYTHON: "(?s)" + "|".join([
        r"#[^\n]*", r"\\\n",
        _PREFIX + r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\z)',
        _PREFIX + r"'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\z)",
        _PREFIX + _PLAIN, _PREFIX + _CHARS, r"\n", r"\w+", r"""[^\w#"'\n\\]+""", ".",
    ]),
}
_LOOP_WORD = r"\b(?:for|foreach|while)\b"
_STRING_START = r"""^(?:[rRbBuUfF]{1,2}|[$@]{1,2}|\$+)?["']"""

# --- fixed values: patterns, messages and confidences of the checks ---------------

SQL_WORD = r"(SELECT|INSERT|UPDATE|DELETE)\s"
JAVA_LOOP_CALLS = (
    "entityManager.persist", "em.persist", "session.save", "session.saveOrUpdate",
    ".executeUpdate", ".executeNonQuery", ".execute(", "em.flush()",
)
PY_LOOP_CALLS = (
    "cursor.execute(", "collection.insert_one(", "collection.update_one(",
    "collection.delete_one(", "session.add(", "session.execute(", ".save(", ".persist(",
)
CS_LOOP_CALLS = (
    "SaveChanges(", "SaveChangesAsync(", "ExecuteNonQuery(", "ExecuteNonQueryAsync(",
    "Execute(", "ExecuteAsync(",
)
JAVA_EXECUTE = r"(?:executeQuery|executeUpdate|execute|createQuery|createNativeQuery|prepareStatement)"
JAVA_SINK = r"(?:executeQuery|executeUpdate|execute|createQuery|prepareStatement)\((\w+)\)"
CS_SINK = r"(?:SqlCommand|ExecuteSql|NpgsqlCommand|OracleCommand)\((\w+)"
PY_SINK = r"execute\(([\w.]+)[),]"
PY_SINK_CLOSED = r"(?:query|text)\(([\w.]+)\)"
PY_SINK_OPEN = r"executemany\(([\w.]+)"

# name -> (order within its language, type, confidence, message)
CHECKS = {
    "java_sql_var": (1, STRING_CONCAT_SQL, 0.92,
                     "SQL injection: SQL string built via concatenation and passed to execute method. "
                     "The variable flow crosses multiple lines, making this harder to spot. "
                     "Use parameterized queries instead."),
    "java_concat_call": (2, STRING_CONCAT_SQL, 0.95,
                         "SQL injection: String concatenation inside execute/query call."),
    "java_loop": (3, UNBATCHED_TXN, 0.90,
                  "N+1 query: %s called inside a loop. Batch operations with "
                  "addBatch()/executeBatch() or collect and flush once outside the loop."),
    "java_transactional": (4, LONG_RUNNING_TXN, 0.85,
                           "@Transactional without timeout parameter. Add timeout "
                           "(e.g., @Transactional(timeout = 30)) to prevent indefinite locks."),
    "java_transactional_args": (5, LONG_RUNNING_TXN, 0.85,
                                "@Transactional with parameters but no timeout set."),
    "java_stmt_prepared": (6, STRING_CONCAT_SQL, 0.88,
                           "Using Statement instead of PreparedStatement. Statement does not support "
                           "parameterized queries, making SQL injection possible."),
    "java_select_star": (7, SELECT_STAR, 0.97,
                         "SELECT * in SQL string literal. Specify explicit columns."),
    "py_sql_var": (1, STRING_CONCAT_SQL, 0.93,
                   "SQL injection: SQL string built via concatenation/formatting and passed to execute(). "
                   "Use parameterized queries: cursor.execute('SELECT ... WHERE id = %s', (uid,))"),
    "py_fstring": (2, STRING_CONCAT_SQL, 0.96,
                   "SQL injection: f-string with SQL keywords passed to execute()."),
    "py_loop": (3, UNBATCHED_TXN, 0.88,
                "N+1 query: %s called inside loop. "
                "Use executemany(), insert_many(), or bulk_write() instead."),
    "py_mongo": (4, READ_PREFERENCE, 0.90,
                 "MongoClient without read_preference. For replica sets, set "
                 "read_preference=ReadPreference.SECONDARY_PREFERRED to distribute reads."),
    "py_connect": (5, LONG_RUNNING_TXN, 0.82,
                   "Database connection without timeout. Add connect_timeout parameter."),
    "py_select_star": (6, SELECT_STAR, 0.97, "SELECT * in SQL string. Specify explicit columns."),
    "cs_sql_var": (1, STRING_CONCAT_SQL, 0.93,
                   "SQL injection: SQL built via string concatenation then passed to command constructor. "
                   "Use parameterized queries with cmd.Parameters.AddWithValue()."),
    "cs_interpolated": (2, STRING_CONCAT_SQL, 0.95,
                        "SQL injection: String interpolation ($\"...\") used to build SQL query. "
                        "Use parameterized queries instead."),
    "cs_loop": (3, UNBATCHED_TXN, 0.92,
                "N+1 query: %s inside loop. Move SaveChanges() outside the loop for batch commit."),
    "cs_txnscope": (4, LONG_RUNNING_TXN, 0.87,
                    "TransactionScope without timeout. Use TransactionScope with "
                    "TransactionOptions { Timeout = TimeSpan.FromSeconds(30) }."),
    "cs_cmd_timeout": (5, LONG_RUNNING_TXN, 0.85,
                       "Database command without CommandTimeout. Set cmd.CommandTimeout = 30 "
                       "to prevent long-running queries from holding locks."),
    "cs_select_star": (6, SELECT_STAR, 0.97,
                       "SELECT * in SQL string literal. Specify explicit columns."),
}

# a file can only have findings when its folded text holds one of these
FLOW_WORDS = (
    "select", "execute", "query", "createstatement", "@transactional", "persist", "save",
    "flush", "mongoclient", "connect", "command", "transactionscope", "_one(", "session.add",
    "insert", "update", "delete",
)

# --- helpers (SQL text) ----------------------------------------------------------

_PY = f"language = '{PYTHON}'"
_names = count()
#: Elements of a running pass that are gathered together.
CHUNK = 64


def _newlines(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, '\\n', '')))"


def _count(expr: str, chars: str) -> str:
    return f"(length({expr}) - length(translate({expr}, '{chars}', '')))"


def _unmarked(expr: str) -> str:
    return f"replace({expr}, char(2), '')"


def _all_matches(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {quote(pattern)}, {group})"


def _first_match(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {quote(pattern)}, {group})"


def _search(expr: str, pattern: str, flags: str = "") -> str:
    return f"{expr} RLIKE {quote(flags + pattern)}"


def _none(kind: str) -> str:
    return f"cast(array() as array<{kind}>)"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a name that stands for a value, which is computed once."""
    name = f"v{next(_names)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def running(array: str, start: str, step: Callable[[str, str], str], show: Callable[[str, str], str],
            kind: str) -> str:
    """SQL: a running pass over an array, as the array of what it shows at every element.

    ``step(state, x)`` is the next state, its fields in the order of ``start``; ``show(state, x)``
    is what is seen before the step, of type ``kind``.  A first pass keeps the state at the start
    of every chunk, then chunks are shown one by one: what a pass gathers is copied at every
    element, so chunks are short.
    """
    o, b, i, x, j = (f"{c}{next(_names)}" for c in "obixj")

    def over(a: str) -> str:
        chunk = f"transform(sequence({b} * {CHUNK}, least(({b} + 1) * {CHUNK}, size({a})) - 1), {j} -> get({a}, {j}))"
        last_state = f"aggregate({chunk}, {o}.s, ({i}, {x}) -> {step(i, x)})"
        starts = (f"aggregate(sequence(0, (size({a}) - 1) div {CHUNK}), {struct(s=start, all=f'slice(array({start}), 1, 0)')}, "
                  f"({o}, {b}) -> {struct(s=last_state, all=f'concat({o}.all, array({o}.s))')}, {o} -> {o}.all)")
        shown = (f"aggregate({chunk}, {struct(s=o, out=_none(kind))}, ({i}, {x}) -> "
                 + struct(s=step(f"{i}.s", x), out=f"concat({i}.out, array({show(f'{i}.s', x)}))") + f", {i} -> {i}.out)")
        return f"CASE WHEN size({a}) = 0 THEN {_none(kind)} ELSE flatten(transform({starts}, ({o}, {b}) -> {shown})) END"

    return let(array, over)


def states(array: str, start: str, step: Callable[[str, str], str], kind: str) -> str:
    """SQL: the states of a running pass after every element; ``kind`` is their type."""
    return let(array, lambda a: f"slice({running(f'concat({a}, slice({a}, 1, 1))', start, step, lambda s, x: s, kind)}, 2, size({a}))")


def _staged(df: DataFrame, drop: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """Adds columns behind a one-element explode, so that no later use computes them again."""
    kept = [c for c in df.columns if c not in drop and c not in columns]
    return df.select(*kept, F.expr(f"inline(array({struct(**columns)}))"))


def _lexemes(text: str) -> str:
    whens = " ".join(f"WHEN '{name}' THEN {_all_matches(text, LEXERS[name])}" for name in LANGUAGES)
    return f"CASE language {whens} END"


_IS_COMMENT = (
    f"(CASE WHEN {_PY} THEN startswith(t, '#') ELSE startswith(t, '//') OR startswith(t, '/*') END)"
)
_IS_STRING = f"(t RLIKE {quote(_STRING_START)})"
# a comment or string body as blanks of the same length; newlines stay
_MASKED = (
    f"CASE WHEN {_IS_COMMENT} THEN regexp_replace(t, '[^\\n]', ' ') "
    f"WHEN {_IS_STRING} AND length(t) > 1 THEN concat('\"', "
    "regexp_replace(substring(t, 2, length(t) - 2), '[^\\n]', ' '), '\"') ELSE t END"
)


def flow_files(files: DataFrame, languages: tuple[str, ...] = LANGUAGES, gated: bool = False) -> DataFrame:
    """Java, Python and C# files; gated: only those that hold a word the checks look for."""
    ends = {JAVA: ".java", PYTHON: ".py", CSHARP: ".cs"}
    kept = with_file_columns(files).where(F.expr(
        " OR ".join(f"endswith(file_path, '{ends[name]}')" for name in languages)))
    if gated:
        kept = kept.where(F.expr(contains_any(fold_sql("content"), FLOW_WORDS)))
    return kept.select("file_path", F.col("rule_language").alias("language"),
                       F.col("platform_base").alias("platform"), "content")


_PLAIN_TEXT = f"translate(content, '{CUT}{MARK}', '  ')"


def code_mask(files: DataFrame) -> DataFrame:
    """Files with comments and string bodies blanked, character for character."""
    return flow_files(files).select("file_path", "language", F.expr(
        f"array_join(transform({_lexemes(_PLAIN_TEXT)}, t -> {_MASKED}), '')").alias("code"))


# --- brackets of a statement -----------------------------------------------------
# Code is cut after every bracket: piece i ends with bracket i.  Raw text is cut at the same
# places, so that pieces of both go together whatever strings hold.


def _pieces(marked: str) -> str:
    return f"split({marked}, char(2), -1)"


def skeleton(marked: str) -> str:
    """Code in which every outermost bracket pair is empty."""
    shown = running(
        _pieces(marked), "0",
        lambda s, x: f"CASE WHEN endswith({x}, '(') THEN {s} + 1 WHEN endswith({x}, ')') THEN greatest({s} - 1, 0) ELSE {s} END",
        lambda s, x: f"CASE WHEN {s} = 0 THEN {x} WHEN {s} = 1 AND endswith({x}, ')') THEN ')' ELSE '' END", "string")
    return f"if(contains({marked}, '('), array_join({shown}, ''), {marked})"


# the dotted name at the end of a piece, with its bracket
_NOT_NAME = r"(?s)^.*(?:[^\w\s.]|\w\s+(?=\w))"
_LINK = r"(?s)^\s*\.[\w\s.]*\($"
_NAMED = r"\w\s*\($"
_PROPERTIES = r"^(?:\s*+\.\s*+\w++)*+"


def _dotted(piece: str) -> str:
    head = f"substring({piece}, 1, length({piece}) - 1)"
    name = f"regexp_replace(regexp_replace({head}, {quote(_NOT_NAME)}, ''), {quote(r'^[\s.]+')}, '')"
    return f"concat({name}, '(')"


def _pairs(pieces: str) -> str:
    """Bracket pairs by level and place: numbers of both brackets, the length of the dotted name in
    front with its bracket, line breaks before it, and whether it goes on after the last pair."""
    levels = running(
        pieces, struct(i="1", level="0", lines="0"),
        lambda s, x: struct(
            i=f"{s}.i + 1",
            level=f"CASE WHEN endswith({x}, '(') THEN {s}.level + 1 WHEN endswith({x}, ')') "
                  f"THEN greatest({s}.level - 1, 0) ELSE {s}.level END",
            lines=f"{s}.lines + {_newlines(x)}"),
        lambda s, x: struct(level=f"CASE WHEN endswith({x}, '(') THEN {s}.level + 1 WHEN endswith({x}, ')') THEN {s}.level "
                                  "ELSE 0 END", i=f"{s}.i", opens=f"endswith({x}, '(')", lines=f"{s}.lines"),
        "struct<level:int,i:int,opens:boolean,lines:int>")

    def pair(b: str) -> str:
        return let(f"get({pieces}, x.i - 1)", lambda p: let(_dotted(p), lambda d: struct(
            level="x.level", o="x.i", c=f"get({b}, j + 1).i", lines=f"x.lines + {_newlines(p)} - {_newlines(d)}",
            tail=f"length({d})", link=_search(p, _LINK), named=_search(p, _NAMED), dots=f"contains({d}, '.')")))

    return let(f"array_sort({levels})", lambda b: (
        f"filter(transform({b}, (x, j) -> if(x.opens AND get({b}, j + 1).level = x.level, {pair(b)}, null)), p -> p is not null)"))


_SITE = "struct<piece:int,tail:int,o:int,c:int,lines:int,hit:boolean,level:int,named:boolean>"


def _chained(pairs: str, pieces: str, name: str, needs_receiver: bool) -> str:
    """Calls of ``name`` with their whole receiver, or what of it no earlier hit has taken."""
    links = f"transform({pairs}, x -> {struct(x='x', hit=_search(f'get({pieces}, x.o - 1)', name))})"

    def step(s: str, e: str) -> str:
        x = f"{e}.x"
        return let(f"{s}.named AND NOT {s}.hit AND {s}.level = {x}.level AND {s}.c + 1 = {x}.o AND {x}.link",
                   lambda joined: struct(
            piece=f"if({joined}, {s}.piece, {x}.o)", tail=f"if({joined}, {s}.tail, {x}.tail)", o=f"{x}.o", c=f"{x}.c",
            lines=f"if({joined}, {s}.lines, {x}.lines)",
            hit=f"{e}.hit AND ({joined} OR {x}.dots)" if needs_receiver else f"{e}.hit",
            level=f"{x}.level", named=f"{x}.named"))

    start = struct(piece="0", tail="0", o="0", c="0", lines="0", hit="false", level="0", named="false")
    return states(links, start, step, _SITE)


def _plain_calls(pairs: str, pieces: str, name: str, start: str | None) -> str:
    """Calls of ``name`` from their dotted name on, or from where ``start`` begins."""
    piece = f"get({pieces}, x.o - 1)"
    if not start:
        site = struct(piece="x.o", tail="x.tail", o="x.o", c="x.c", lines="x.lines", hit=_search(piece, name))
    else:
        site = let(piece, lambda p: let(_first_match(p, f"({start})$"), lambda d: struct(
            piece="x.o", tail=f"length({d})", o="x.o", c="x.c",
            lines=f"x.lines + {_newlines(f'right({p}, x.tail)')} - {_newlines(d)}", hit=_search(p, name))))
    return f"transform({pairs}, x -> {site})"


def _followed(pairs: str, raws: str, words: tuple[str, ...]) -> str:
    """For every pair, by place: the last bracket of the links after it, and whether the arguments
    of one of them lack all words."""
    args = f"lower({_args(raws, 'x')})"
    links = f"reverse(transform({pairs}, x -> {struct(x='x', lacks=f'NOT {contains_any(args, words)}')}))"

    def step(s: str, e: str) -> str:
        x = f"{e}.x"
        return let(f"{s}.link AND {s}.level = {x}.level AND {s}.o = {x}.c + 1", lambda joined: struct(
            level=f"{x}.level", o=f"{x}.o", link=f"{x}.link", c=f"if({joined}, {s}.c, {x}.c)",
            lacks=f"({joined} AND {s}.lacks) OR {e}.lacks"))

    start = struct(level="0", o="0", link="false", c="0", lacks="false")
    return f"reverse({states(links, start, step, 'struct<level:int,o:int,link:boolean,c:int,lacks:boolean>')})"


def _args(raws: str, site: str) -> str:
    return f"concat('(', {_joined(raws, f'{site}.o', f'{site}.c')})"


def _joined(pieces: str, after: str, last: str) -> str:
    """The text after piece ``after`` up to piece ``last``, at least one."""
    j = f"j{next(_names)}"
    return f"array_join(transform(sequence({after}, {last} - 1), {j} -> get({pieces}, {j})), '')"


def call_sites(name: str, start: str | None = None, chained: bool = False, needs_receiver: bool = False,
               words: tuple[str, ...] = ()) -> str:
    """SQL: the calls in the prepared statement ``s`` as array of (call, args, lines, lacks).

    ``name`` matches the code up to the opening bracket.  A call inside the arguments of one
    found is not looked at.  ``chained``: the call begins with its receiver.  ``words``: the
    call goes on with the links after it, and ``lacks`` tells whether some arguments hold none
    of the words.
    """
    shared = dict(piece="x.piece", back="-x.tail", o="x.o", c="x.c", lines="x.lines")

    def found(pieces: str, raws: str, pairs: str) -> str:
        sites = _chained(pairs, pieces, name, needs_receiver) if chained else _plain_calls(pairs, pieces, name, start)
        if words:
            sites = (f"zip_with({sites}, {_followed(pairs, raws, words)}, (x, y) -> "
                     f"if(x.hit, {struct(**shared, to='y.c', lacks='y.lacks')}, null))")
        else:
            sites = f"transform({sites}, x -> if(x.hit, {struct(**shared, to='x.c', lacks='false')}, null))"
        outer = let(f"array_sort(filter({sites}, x -> x is not null))", lambda b: let(
            running(b, "0", lambda s, x: f"greatest({s}, {x}.to)", lambda s, x: f"{x}.piece > {s}", "boolean"),
            lambda free: f"filter({b}, (x, j) -> get({free}, j))"))
        rest = f"regexp_extract(get({raws}, x.to), {quote(_PROPERTIES)}, 0)" if words else "''"
        call = (f"concat(right(get({raws}, x.piece - 1), -x.back), "
                f"{_joined(raws, 'x.piece', 'x.to')}, coalesce({rest}, ''))")
        return f"transform({outer}, x -> {struct(call=call, args=_args(raws, 'x'), lines='x.lines', lacks='x.lacks')})"

    return found("s.pieces", "s.raws", "s.pairs")


# --- statements ----------------------------------------------------------------

_IS_CUT = f"CASE WHEN {_PY} THEN t = '\\n' ELSE t IN ('{{', '}}', ';') END"
_BRACKETED = "if(contains(t, '(') OR contains(t, ')'), regexp_replace(t, '([()])', concat('$1', char(2))), t)"
_TRIVIA = r"(?s)^(?:\s|//[^\n]*\n|/\*.*?\*/)*+"


def _with_pieces(df: DataFrame) -> DataFrame:
    """Pieces between code-level delimiters, raw and masked, with every code-level bracket marked."""
    lexeme = (f"CASE WHEN {_IS_CUT} THEN {struct(raw='concat(t, char(1))', code='concat(t, char(1))')} "
              f"WHEN {_IS_COMMENT} OR {_IS_STRING} THEN {struct(raw='t', code=_MASKED)} "
              f"ELSE {let(_BRACKETED, lambda t: struct(raw=t, code=t))} END")
    df = _staged(df, lexemes=f"transform({_lexemes(_PLAIN_TEXT)}, t -> {lexeme})")
    df = _staged(df, ("lexemes",), raws="split(array_join(lexemes.raw, ''), char(1), -1)",
                 codes="split(array_join(lexemes.code, ''), char(1), -1)")
    opened = (f"CASE WHEN {_PY} THEN {_count('c', '([{')} - {_count('c', ')]}')} "
              f"ELSE {_count('c', '([')} - {_count('c', ')]')} END")
    term = (f"CASE WHEN {_PY} THEN '\\n' WHEN right(c, 1) IN ('{{', '}}', ';') THEN right(c, 1) ELSE '' END")
    piece = struct(raw="r", code="c", opened=opened, term=term, size=f"length({_unmarked('r')})", lines=_newlines("c"))
    return _staged(df, ("codes",), pieces=f"filter(zip_with(raws, codes, (r, c) -> {piece}), p -> p.raw <> '')")


def _with_statements(df: DataFrame) -> DataFrame:
    """``stmts``: the logical statements of a file, in order.

    A ``;`` ends a statement only when no bracket opened since the last brace is open,
    a newline (Python) only when no bracket is open at all.
    """
    df = _with_pieces(df)

    def step(s: str, x: str) -> str:
        brace = f"{x}.term IN ('{{', '}}')"
        return struct(line=f"{s}.line + {x}.lines", off=f"{s}.off + {x}.size",
                      balance=f"if({brace}, 0, {s}.balance + {x}.opened)",
                      no=f"{s}.no + if({brace} OR {s}.balance + {x}.opened <= 0, 1, 0)")

    df = _staged(df, at=running(
        "pieces", struct(line="1", off="0", balance="0", no="0"), step,
        lambda s, x: struct(no=f"{s}.no", line=f"{s}.line", off=f"{s}.off + {x}.size"), "struct<no:int,line:int,off:int>"))
    df = _staged(df, firsts="filter(transform(at, (a, i) -> if(i = 0 OR a.no <> get(at, i - 1).no, i + 1, null)), i -> i is not null)")
    last = "(coalesce(get(firsts, k + 1), size(pieces) + 1) - 1)"  # number of the statement's last piece
    ahead = _unmarked(f"array_join(slice(raws, {last} + 1, 120), '')")  # a piece has a character at least
    stitched = let(f"slice(pieces, f, {last} + 1 - f)", lambda p: struct(
        no="get(at, f - 1).no", raw=f"array_join({p}.raw, '')", masked=strip_sql(f"array_join({p}.code, '')"),
        ahead=f"CASE WHEN {_search(f'element_at({p}.code, -1)', _LOOP_WORD)} THEN substring({ahead}, 1, 120) END",
        term=f"element_at({p}.term, -1)", line0="get(at, f - 1).line", end_off=f"get(at, {last} - 1).off"))
    df = _staged(df, ("at", "raws", "pieces", "firsts"),
                 stmts=f"filter(transform(firsts, (f, k) -> {stitched}), s -> s.masked <> '')")
    # lead: without blanks and comments in front; marked: the same with its marks, cut like
    # masked; text: also without the final line break
    lead = f"CASE WHEN {_PY} THEN regexp_replace(s.raw, '^\\\\s+', '') ELSE regexp_replace(s.raw, {quote(_TRIVIA)}, '') END"
    return _staged(df, stmts="transform(stmts, s -> " + let(lead, lambda marked: let(
        _unmarked(marked), lambda lead: struct(
            no="s.no", raw=_unmarked("s.raw"), masked="s.masked", marked=marked, ahead="s.ahead", term="s.term",
            end_off="s.end_off", code=_unmarked("s.masked"), lead=lead, skeleton=_unmarked(skeleton("s.masked")),
            text=f"CASE WHEN {_PY} THEN {strip_sql(lead)} ELSE {lead} END",
            line=f"s.line0 + {_newlines('s.raw')} - {_newlines(lead)}",
            indent="length(regexp_extract(s.raw, '^([ \\\\t]*)', 1))"))) + ")")


def statements(files: DataFrame) -> DataFrame:
    """One row per logical statement with line, text, masked code and terminator."""
    return _with_statements(flow_files(files)).select("file_path", "language", "platform", F.expr("inline(stmts)"))


# --- blocks --------------------------------------------------------------------

# Headers, as skeletons, that open something else than a statement block.
_JAVA_NOT_BLOCK = (
    r"\b(?:class|interface|enum|record)\s+\w+", r"\bswitch\s*\(", r"[=\]]\s*\{$",
    r"\bnew\s+[\w.<>, ]+\s*\(\)\s*\{$",
    r"^(?:@\w+(?:\(\))?\s+)*+(?:(?:public|protected|private)\s+)?(?:<[^>]*>\s*)?"
    r"[A-Z]\w*\s*\(\)\s*(?:throws\s+[\w.,\s]+)?\{$",
)
_CS_NOT_BLOCK = (
    r"\b(?:class|struct|interface|enum|record|namespace)\s+\w+", r"\bswitch\b",
    r"[=\]]\s*\{$", r"\bnew\b[\w\s.<>,\[\]?]*(?:\(\))?\s*\{$",
    # a property: a name without parameters
    r"^(?!(?:else|try|finally|do|get|set|init|add|remove|checked|unchecked|unsafe|catch)\b)"
    r"[^()]*\w\s*\{$",
)
# statements without braces that may stand before a loop: if (..) for (..) ..
_BEFORE_LOOP = r"(?:(?:\w+\s*:(?!:)|else\b|(?:if|using|lock|fixed|synchronized)\s*\(\))\s*)*+"
_LOOP_START = {
    JAVA: "^" + _BEFORE_LOOP + r"(?:for|while)\s*\(",
    CSHARP: "^" + _BEFORE_LOOP + r"(?:await\s+)?(?:for|foreach|while)\s*\(",
    PYTHON: r"^(?:async\s+)?(?:for|while)\b",
}
_LOOP_HEADER = r"\b((?:await\s+)?(?:for|foreach|while)\s*\()$"
_DO_TAIL = r"^while\s*\(\)\s*;$"


def _search_any(expr: str, patterns) -> str:
    return "(" + " OR ".join(_search(expr, p) for p in patterns) + ")"


_IS_LOOP = "CASE language " + " ".join(
    f"WHEN '{name}' THEN {_search('s.skeleton', p)}" for name, p in _LOOP_START.items()) + " END"
# opens a statement block (Java, C#) or a function (Python)
_IS_SCOPE = (
    f"CASE WHEN {_PY} THEN {_search('s.code', r'^(?:async\s+)?def\b')} WHEN s.term <> '{{' THEN false "
    f"WHEN language = '{JAVA}' THEN NOT {_search_any('s.skeleton', _JAVA_NOT_BLOCK)} "
    f"ELSE NOT {_search_any('s.skeleton', _CS_NOT_BLOCK)} END"
)
_STATEMENT = ("no", "raw", "masked", "marked", "ahead", "term", "end_off", "code", "lead", "text", "line", "indent",
              "skeleton")


def _more(name: str, fields: tuple[str, ...], **added: str) -> str:
    return struct(**{f: f"{name}.{f}" for f in fields}, **added)


def _with_ranges(df: DataFrame) -> DataFrame:
    """Adds to every opener the last statement of what it opens (``last_no``, ``last_off``).

    What is never closed ends with the file.
    """
    df = _staged(df, blocks="transform(stmts, (s, i) -> " + struct(
        is_loop=f"{_IS_LOOP} AND NOT (coalesce(get(stmts, i - 1).term = '}}', false) AND {_search('s.skeleton', _DO_TAIL)})",
        is_scope=_IS_SCOPE) + ")")
    # braces: by level from the end, the last closer seen is the next one in the file
    levels = running(
        "stmts", "0", lambda s, x: f"{s} + CASE {x}.term WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END",
        lambda s, x: struct(level=f"CASE {x}.term WHEN '{{' THEN {s} + 1 WHEN '}}' THEN {s} END", back=f"-{x}.no",
                            closes=f"{x}.term = '}}'", off=f"{x}.end_off"),
        "struct<level:int,back:int,closes:boolean,off:int>")
    no_end = "struct(cast(null as int) AS level, cast(null as int) AS last_no, cast(null as int) AS last_off)"
    braces = running(
        f"array_sort({levels})", no_end,
        lambda s, x: (f"CASE WHEN {x}.closes THEN {struct(level=f'{x}.level', last_no=f'-{x}.back', last_off=f'{x}.off')} "
                      f"WHEN {x}.level <=> {s}.level THEN {s} "
                      f"ELSE {struct(level=f'{x}.level', last_no='cast(null as int)', last_off='cast(null as int)')} END"),
        lambda s, x: struct(no=f"-{x}.back", opens=f"{x}.level is not null AND NOT {x}.closes",
                            last_no=f"if({x}.level <=> {s}.level, {s}.last_no, null)",
                            last_off=f"if({x}.level <=> {s}.level, {s}.last_off, null)"),
        "struct<no:int,opens:boolean,last_no:int,last_off:int>")
    # indents: from the end, the nearest statement that is indented as little; what is indented
    # more than the statement seen can close nothing before it
    kind = "struct<indent:int,last_no:int,last_off:int>"
    indents = running(
        "reverse(transform(stmts, (s, i) -> " + struct(no="s.no", indent="s.indent", last_no="s.no - 1",
                                                        last_off="get(stmts, i - 1).end_off") + "))",
        _none(kind),
        lambda s, x: (f"concat(filter({s}, e -> e.indent < {x}.indent), "
                      f"array({struct(indent=f'{x}.indent', last_no=f'{x}.last_no', last_off=f'{x}.last_off')}))"),
        lambda s, x: let(f"try_element_at(filter({s}, e -> e.indent <= {x}.indent), -1)", lambda e: struct(
            no=f"{x}.no", opens="true", last_no=f"{e}.last_no", last_off=f"{e}.last_off")),
        "struct<no:int,opens:boolean,last_no:int,last_off:int>")
    df = _staged(df, ends=f"if({_PY}, reverse({indents}), array_sort({braces}))")

    def end(e: str, field: str, of_file: str) -> str:
        opens = f"if({_PY}, get(blocks, i).is_loop OR get(blocks, i).is_scope, {e}.opens)"
        return f"if({opens}, coalesce({e}.{field}, element_at(stmts, -1).{of_file}), null)"

    return _staged(df, ("blocks", "ends"), stmts="transform(stmts, (s, i) -> " + let("get(ends, i)", lambda e: _more(
        "s", _STATEMENT, is_loop="get(blocks, i).is_loop", is_scope="get(blocks, i).is_scope",
        last_no=end(e, "last_no", "no"), last_off=end(e, "last_off", "end_off"))) + ")")


def _with_scope(df: DataFrame) -> DataFrame:
    """Adds the innermost enclosing scope of each statement (``scope_no``, ``scope_last``)."""
    def event(pos: str, phase: str, delta: str, scope: bool) -> str:
        return struct(pos=pos, phase=phase, delta=delta, no="s.no", last=f"if({str(scope).lower()}, s.last_no, null)")

    point, opening = event("s.no", "1", "0", False), event("s.no", "2", "1", True)
    closing = event(f"if({_PY}, s.last_no + 1, s.last_no)", f"if({_PY}, 0, 2)", "-1", False)
    events = f"flatten(transform(stmts, s -> if(s.is_scope, array({point}, {opening}, {closing}), array({point}))))"
    nested = running(
        f"array_sort({events})", "0", lambda s, x: f"{s} + {x}.delta",
        lambda s, x: struct(nesting=f"{s} + {x}.delta", pos=f"{x}.pos", phase=f"{x}.phase", delta=f"{x}.delta",
                            no=f"{x}.no", last=f"{x}.last"),
        "struct<nesting:int,pos:int,phase:int,delta:int,no:int,last:int>")
    kind = struct(nesting="{0}", no="{1}", last="{2}")
    inside = running(
        f"array_sort({nested})", kind.format("-1", "cast(null as int)", "cast(null as int)"),
        lambda s, x: (f"CASE WHEN {x}.delta = 1 THEN {kind.format(f'{x}.nesting', f'{x}.no', f'{x}.last')} "
                      f"WHEN {x}.nesting = {s}.nesting THEN {s} "
                      f"ELSE {kind.format(f'{x}.nesting', 'cast(null as int)', 'cast(null as int)')} END"),
        lambda s, x: let(f"{x}.delta = 0 AND {x}.nesting > 0 AND {x}.nesting = {s}.nesting", lambda known: struct(
            no=f"{x}.no", point=f"{x}.delta = 0", scope_no=f"if({known}, {s}.no, null)",
            scope_last=f"if({known}, {s}.last, null)")),
        "struct<no:int,point:boolean,scope_no:int,scope_last:int>")
    df = _staged(df, scopes=f"array_sort(filter({inside}, e -> e.point))")
    return _staged(df, ("scopes",), stmts="transform(stmts, (s, i) -> " + _more(
        "s", (*_STATEMENT, "is_loop", "is_scope", "last_no", "last_off"), scope_no="get(scopes, i).scope_no",
        scope_last="get(scopes, i).scope_last") + ")")


def placed_statements(files: DataFrame) -> DataFrame:
    """One row per statement with what it opens and the scope it stands in."""
    return _with_scope(_with_ranges(_with_statements(flow_files(files)))).select(
        "file_path", "language", "platform", F.expr("inline(stmts)"))


def scope_blocks(files: DataFrame) -> DataFrame:
    """Statement blocks (Java, C#) and functions (Python) with first and last statement."""
    rows = _with_ranges(_with_statements(flow_files(files))).select("file_path", "language", F.expr("inline(stmts)"))
    return rows.where("is_scope").select(
        "file_path", "language", F.col("no").alias("first_no"), "last_no", "line", F.col("code").alias("header"))


def loop_blocks(files: DataFrame) -> DataFrame:
    """Loops with first and last statement."""
    rows = _with_ranges(_with_statements(flow_files(files))).select("file_path", "language", F.expr("inline(stmts)"))
    return rows.where("is_loop").select(
        "file_path", "language", F.col("no").alias("first_no"), F.coalesce("last_no", "no").alias("last_no"), "line")


# --- facts (SQL text, about statement ``s``) -------------------------------------

# an event has no name; an interval with a key holds if an event of that key falls into it, or,
# for the checks of ABSENT, if none does
_FIELDS = {"no": "int", "name": "string", "item": "int", "k": "int", "key": "string", "pos": "int", "hi": "int",
           "line": "int", "quoted": "string"}
ABSENT = ("cs_cmd_timeout",)
LOOP_CALLS = {"java_loop": JAVA_LOOP_CALLS, "py_loop": PY_LOOP_CALLS, "cs_loop": CS_LOOP_CALLS}
_NO_FACTS = _none("struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS.items()) + ">")
_TEXT120 = f"substring({strip_sql('s.text')}, 1, 120)"
# an interval covers the inside of the enclosing block
_BLOCK = {"pos": "(s.scope_no + 1) * 2", "hi": "s.scope_last * 2 + 1"}


def _fact(**values: str) -> str:
    values = {"no": "s.no", "item": "0", "k": "0", **values}
    return struct(**{n: f"cast({values.get(n, 'null')} as {t})" for n, t in _FIELDS.items()})


def _when(condition: str, facts: str) -> str:
    return f"CASE WHEN {condition} THEN {facts} ELSE {_NO_FACTS} END"


def _one(condition: str, **values: str) -> str:
    return _when(condition, f"array({_fact(**values)})")


def _calls(condition: str, name: str, test: str, sites: str, **more: str) -> str:
    """Facts for the calls ``c`` of the statement that pass ``test``."""
    fact = _fact(name=quote(name), line="s.line + c.lines", quoted="substring(c.call, 1, 120)", item="i", **more)
    return _when(condition, f"transform(filter({sites}, c -> {test}), (c, i) -> {fact})")


def _matches(condition: str, name: str, pattern: str, test: str, **more: str) -> str:
    """Facts for the matches ``c`` of a pattern in the code that pass ``test``."""
    before = "substring(s.code, 1, greatest(position(c, s.code), 1) - 1)"
    fact = _fact(name=quote(name), line=f"s.line + {_newlines(before)}", quoted="substring(c, 1, 120)", item="-1 - i", **more)
    return _when(condition, f"transform(filter({_all_matches('s.code', pattern)}, c -> {test}), (c, i) -> {fact})")


def _var_events(condition: str, *patterns: tuple[str, bool]) -> str:
    """Events keyed by the variable in group 1, or by its prefixes.

    Only prefixes as long as a name declared in the file can meet one, so a long identifier
    does not become an event for each of its characters.
    """
    lists = []
    for pattern, prefixes in patterns:
        names = _all_matches("s.raw", pattern, 1)
        if prefixes:
            names = (f"flatten(transform({names}, v -> transform(filter(name_sizes, n -> n <= length(v)), "
                     f"n -> substring(v, 1, n))))")
        lists.append(names)
    fact = _fact(key="concat('var ', v)", pos="s.no * 2 + 1")
    return _when(condition,
                 f"transform(array_distinct(concat({', '.join(lists)})), v -> {fact})")


def _word_events(words: dict[str, str]) -> str:
    """Events (key -> word) where the statement, or the comments before it, hold a word."""
    pairs = "array(" + ", ".join(struct(key=f"'{k}'", word=quote(w)) for k, w in words.items()) + ")"
    fact = _fact(key="w.key", pos="s.no * 2 + if(contains(s.lead, w.word), 1, 0)")
    return f"transform(filter({pairs}, w -> contains(s.raw, w.word)), w -> {fact})"


def _loop_facts(name: str) -> list[str]:
    """One interval per call pattern, and the events; the first pattern that has an event names the hit."""
    calls = LOOP_CALLS[name]
    pairs = "array(" + ", ".join(struct(k=str(i), call=quote(c)) for i, c in enumerate(calls)) + ")"

    def intervals(loop: str) -> str:
        whole = f"concat({loop}, coalesce(s.ahead, ''))"
        size = f"coalesce(s.last_off, s.end_off) - s.end_off + length({loop})"
        quoted = f"substring({strip_sql(f'substring({whole}, 1, {size})')}, 1, 120)"
        common = {"name": quote(name), "line": f"s.line + {_newlines('s.lead')} - {_newlines(loop)}", "quoted": quoted,
                  "k": "p.k"}
        inside = _fact(
            key="concat('loop ', p.k)", hi="coalesce(s.last_no, s.no) * 2 + 1",
            pos="(s.no + 1) * 2" if name == "py_loop" else "s.no * 2 + 1", **common)
        facts = f"transform({pairs}, p -> {inside})"
        if name == "py_loop":  # a body on the line of the header
            body = _first_match("s.text", r"(?s)^[^\n]*?:\s*(?!#)(\S.*)$")
            facts = (f"concat({facts}, " + let(body, lambda b: f"transform(filter({pairs}, p -> contains({b}, p.call)), "
                                                               f"p -> {_fact(**common)})") + ")")
        return facts

    return [_when("s.is_loop", intervals("s.loop")), _word_events({f"loop {i}": c for i, c in enumerate(calls)})]


def _string_facts(name: str, test: Callable[[str], str]) -> str:
    """Facts for the string lexemes that pass ``test``."""
    fact = _fact(name=quote(name), line="e.line", quoted=f"substring({strip_sql('e.t')}, 1, 120)", item="i")
    return f"transform(filter(s.strings, e -> {test('e.t')}), (e, i) -> {fact})"


def _star(t: str) -> str:
    return f"{_search(t, SELECT_STAR_RX, NOCASE)} AND NOT {_search(t, COUNT_STAR_RX, NOCASE)}"


_BUILT_SQL = f"contains(s.text, '+') AND {_search('s.text', SQL_WORD, NOCASE)}"
_BUILT_ARGS = ("contains(c.args, '+') AND "
               + _search("c.args", r"""^[^"'\n]*+["'].*(?:SELECT|INSERT|UPDATE|DELETE)""", NOCASE.replace(")", "m)")))


def _java_facts() -> dict[str, list[str]]:
    decl = (
        r"^(?!(?:return|throw|else|case|new|assert|yield|package|import)\b)"
        r"(?:final\s+|@\w+(?:\([^)]*\))?\s+)*+[\w.]+(?:<[^=;]*>)?(?:\s*\[\s*\])*\s+(\w+)"
        r"(?:\s*\[\s*\])*\s*="
    )
    name = _first_match("s.code", decl)
    is_decl = f"s.scope_no is not null AND {name} <> ''"
    annotated = "contains(s.code, '@Transactional')"
    return {
        "java_sql_var": [
            _one(f"{is_decl} AND {_BUILT_SQL}", name="'java_sql_var'", key=f"concat('var ', {name})",
                 line="s.line", quoted=_TEXT120, **_BLOCK),
            _var_events(contains_any("s.raw", ("execute", "createQuery", "prepareStatement")), (JAVA_SINK, False))],
        "java_concat_call": [
            _calls(f"contains(s.text, '+') AND {_search('s.code', JAVA_EXECUTE + r'\s*\(')}", "java_concat_call",
                   _BUILT_ARGS, call_sites(r"\b" + JAVA_EXECUTE + r"\s*\($", chained=True))],
        "java_loop": _loop_facts("java_loop"),
        "java_transactional": [
            _matches(annotated, "java_transactional", r"@Transactional\w*+(?!\s*\()", "NOT contains(lower(c), 'timeout')")],
        "java_transactional_args": [
            _calls(annotated, "java_transactional_args", "NOT contains(lower(c.call), 'timeout')",
                   call_sites(r"@Transactional\w*\s*\($", start=r"@Transactional\w*\s*\("))],
        "java_stmt_prepared": [
            _one(f"{is_decl} AND contains(s.text, 'createStatement()') AND NOT contains(s.text, 'PreparedStatement')",
                 name="'java_stmt_prepared'", key="'executeQuery'", line="s.line", quoted=_TEXT120, **_BLOCK),
            _word_events({"executeQuery": "executeQuery"})],
        "java_select_star": [_string_facts("java_select_star", _star)],
    }


_CS_DECL = (
    r"^(?!(?:return|throw|else|case|new|goto|yield)\b)"
    r"(?:(?:using|await|const|static|readonly|scoped|ref)\s+)*+"
    r"[\w.]+(?:<[^=;]*>)?\??(?:\s*\[[\s,]*\])*\??\s+(\w+)\s*=(?![=>])"
)
_PY_ASSIGN = r"(?s)^([\w.]+)\s*(?::[^=]+?)?=(?!=)\s*(.*)$"
# length of the name that a statement gives a value; null where prefixes of it are not looked for
_NAME_SIZE = (
    f"nullif(length(CASE WHEN {_PY} THEN {_first_match('s.code', _PY_ASSIGN)} "
    f"WHEN language = '{CSHARP}' THEN {_first_match('s.code', _CS_DECL)} END), 0)"
)


def _cs_facts() -> dict[str, list[str]]:
    name = _first_match("s.code", _CS_DECL)
    command = r"\bnew\s+[\w.]*(?:SqlCommand|NpgsqlCommand|OracleCommand)\w*\s*"
    scope = r"\bnew\s+[\w.]*TransactionScope\w*\s*"
    no_timeout = "NOT contains({0}, 'Timeout') AND NOT contains({0}, 'TransactionOptions')"
    in_block = "s.scope_no is not null AND contains(s.code, 'Command')"
    set_later = {"key": "'CommandTimeout'", **_BLOCK}
    return {
        "cs_sql_var": [
            _one(f"s.scope_no is not null AND {name} <> '' AND {_BUILT_SQL}", name="'cs_sql_var'",
                 key=f"concat('var ', {name})", line="s.line", quoted=_TEXT120, **_BLOCK),
            _var_events(contains_any("s.raw", ("Command(", "ExecuteSql(")), (CS_SINK, True))],
        "cs_loop": _loop_facts("cs_loop"),
        "cs_txnscope": [
            _calls("contains(s.code, 'TransactionScope')", "cs_txnscope", no_timeout.format("c.call"),
                   call_sites(scope + r"\($", start=scope + r"\(")),
            _matches("contains(s.code, 'TransactionScope')", "cs_txnscope", scope + r"\{", no_timeout.format("c"))],
        "cs_cmd_timeout": [
            _calls(in_block, "cs_cmd_timeout", "true", call_sites(command + r"\($", start=command + r"\("), **set_later),
            _matches(in_block, "cs_cmd_timeout", command + r"\{", "true", **set_later),
            _word_events({"CommandTimeout": "CommandTimeout"})],
        "cs_interpolated": [_string_facts("cs_interpolated", lambda t: (
            _search(t, r'^(?:\$+|\$@|@\$)"') + " AND " + _search(t, SQL_WORD, NOCASE)))],
        "cs_select_star": [_string_facts("cs_select_star", _star)],
    }


def _py_facts() -> dict[str, list[str]]:
    name, rhs_code = _first_match("s.code", _PY_ASSIGN), _first_match("s.code", _PY_ASSIGN, 2)
    rhs = _first_match("s.text", _PY_ASSIGN, 2)

    def outer(code: str) -> str:
        """Code outside all brackets."""
        opens, closes = "right({0}, 1) IN ('(', '[', '{{')", "right({0}, 1) IN (')', ']', '}}')"
        shown = running(
            _all_matches(code, r"[^()\[\]{}]*[()\[\]{}]|[^()\[\]{}]+"), "0",
            lambda s, x: f"CASE WHEN {opens.format(x)} THEN {s} + 1 WHEN {closes.format(x)} THEN greatest({s} - 1, 0) ELSE {s} END",
            lambda s, x: f"if({s} = 0, translate({x}, '()[]{{}}', ''), '')", "string")
        return f"array_join({shown}, '')"

    # operators outside brackets make the right side an expression; else it is one value
    def expression(code: str) -> str:
        return let(outer(code), lambda o: f"{_search(o, r'[+\-*/%|&^]')} AND NOT {_search(o, r'^lambda\b')}")

    literal = _search(rhs_code, r'^"[^"]*"(?:\s*"[^"]*")*+$')
    built = (
        f"{name} <> '' AND {_search(rhs, SQL_WORD, NOCASE)} "
        f"AND (contains({rhs}, '+') OR contains({rhs}, '%') OR contains({rhs}, '{{')) "
        f"AND ({expression(rhs_code)} OR {literal} OR contains({rhs}, '%'))"
    )
    fstring = (
        r"""(?:^\(|,)\s*(f(?:"{3}(?:[^"]|"(?!""))*+"{3}|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'))\s*(?=[,)])"""
    )
    connect = r"(?:psycopg2\.connect|pymysql\.connect|cx_Oracle\.connect)\w*\s*\($"
    return {
        "py_sql_var": [
            _one(built, name="'py_sql_var'", key=f"concat('var ', {name})", line="s.line",
                 quoted=_TEXT120, pos="coalesce(s.scope_no * 2 + 1, 0)",
                 hi="coalesce(s.scope_last, element_at(stmts, -1).no) * 2 + 1"),
            _var_events(contains_any("s.raw", ("execute", "query(", "text(")),
                        (PY_SINK, False), (PY_SINK_CLOSED, False), (PY_SINK_OPEN, True))],
        "py_fstring": [
            _calls(_search("s.code", r"\.\s*(?:execute|query|run)\w*\s*\("), "py_fstring",
                   f"exists({_all_matches('c.args', fstring, 1)}, g -> {_search('g', SQL_WORD, NOCASE)})",
                   call_sites(r"\.\s*(?:execute|query|run)\w*\($", chained=True, needs_receiver=True))],
        "py_loop": _loop_facts("py_loop"),
        "py_mongo": [
            _calls("contains(s.code, 'MongoClient')", "py_mongo", "c.lacks",
                   call_sites(r"MongoClient\w*\s*\($", words=("read_preference", "readpreference")))],
        "py_connect": [
            _calls("contains(s.code, 'connect')", "py_connect", "c.lacks", call_sites(connect, words=("timeout",)))],
        "py_select_star": [_string_facts("py_select_star", _star)],
    }


_BUILDERS = {JAVA: _java_facts, CSHARP: _cs_facts, PYTHON: _py_facts}


#: Words of the calls that are looked at, and of the statements inside strings.
_CALL_WORDS = ("@Transactional", "execute", "createQuery", "createNativeQuery", "prepareStatement", "TransactionScope",
               "Command", "query", "run", "MongoClient", "connect")
_STRING_WORDS = ("select", "insert", "update", "delete")


def _with_details(df: DataFrame) -> DataFrame:
    """Adds what the facts share: pieces and bracket pairs, strings with their lines, loops from their header on."""
    wants_calls = f"s.is_loop OR {contains_any('s.code', _CALL_WORDS)}"
    strings = running(_lexemes("s.raw"), f"s.line - {_newlines('s.raw')} + {_newlines('s.lead')}",
                      lambda s, x: f"{s} + {_newlines(x)}", lambda s, x: struct(t=x, line=s), "struct<t:string,line:int>")
    strings = f"filter({strings}, e -> {_search('e.t', _STRING_START)})"
    fields = (*_STATEMENT, "is_loop", "is_scope", "last_no", "last_off", "scope_no", "scope_last")

    def header(pieces: str, raws: str, pairs: str) -> str:
        """What stands before the header of a loop is not quoted."""
        place = f"get(filter({pairs}, x -> x.level = 1 AND {_search(f'get({pieces}, x.o - 1)', _LOOP_HEADER)}), 0).o"
        loop = let(place, lambda o: (
            f"concat(right(get({raws}, {o} - 1), length({_first_match(f'get({pieces}, {o} - 1)', _LOOP_HEADER)})), "
            f"array_join(slice({raws}, {o} + 1, size({raws})), ''))"))
        return (f"CASE WHEN NOT s.is_loop THEN null WHEN {_search('s.code', r'^(?:async|await|for|foreach|while)\b')} "
                f"THEN s.lead ELSE {loop} END")

    # other statements can make no fact; the statements of strings are among these words
    hot = f"filter(stmts, s -> s.is_loop OR {contains_any(fold_sql('s.raw'), (*FLOW_WORDS, 'text('))})"
    return _staged(df, stmts=f"transform({hot}, s -> " + let(
        f"if({wants_calls}, {_pieces('s.masked')}, null)", lambda pieces: let(
            f"if({wants_calls}, {_pieces('s.marked')}, null)", lambda raws: let(
                f"if({wants_calls}, {_pairs(pieces)}, null)", lambda pairs: _more(
                    "s", fields, pieces=pieces, raws=raws, pairs=pairs, loop=header(pieces, raws, pairs),
                    strings=f"if({contains_any(fold_sql('s.raw'), _STRING_WORDS)}, {strings}, "
                            f"{_none('struct<t:string,line:int>')})")))) + ")")


def _with_hits(files: DataFrame, checks: tuple[str, ...] | None) -> DataFrame:
    """Files with ``hits``: what the wanted checks (all, if none are named) find in them."""
    wanted = {language: [f for name, facts in build().items() if not checks or name in checks for f in facts]
              for language, build in _BUILDERS.items()}
    languages = tuple(language for language, facts in wanted.items() if facts)
    df = _with_details(_with_scope(_with_ranges(_with_statements(flow_files(files, languages, gated=True)))))
    df = _staged(df, name_sizes=f"array_distinct(filter(transform(stmts, s -> {_NAME_SIZE}), n -> n is not null))")
    facts = "CASE language " + " ".join(f"WHEN '{name}' THEN concat({', '.join(wanted[name])})" for name in languages) + " END"
    df = _staged(df, ("stmts", "name_sizes"), facts=f"flatten(transform(stmts, s -> {facts}))")
    # from the end of the file, the last event seen of a key is the next one; at one place events come first
    keyed = ("array_sort(transform(filter(facts, f -> f.key is not null), f -> "
             + struct(key="f.key", back="-f.pos", late="if(f.name is null, 0, 1)", f="f") + "))")
    fact_type = _NO_FACTS.split(" as array<", 1)[1][:-2]
    seen = running(
        keyed, struct(key="''", pos="cast(null as int)"),
        lambda s, x: (f"CASE WHEN {x}.late = 0 THEN {struct(key=f'{x}.key', pos=f'-{x}.back')} WHEN {s}.key = {x}.key "
                      f"THEN {s} ELSE {struct(key=f'{x}.key', pos='cast(null as int)')} END"),
        lambda s, x: struct(f=f"{x}.f", holds=f"{x}.late = 1 AND coalesce({s}.key = {x}.key AND {s}.pos <= {x}.f.hi, false) "
                                              f"<> ({x}.f.name IN ({', '.join(map(quote, ABSENT))}))"),
        f"struct<f:{fact_type},holds:boolean>")
    df = _staged(df, ("facts",), kept=f"concat(filter(facts, f -> f.key is null), filter({seen}, e -> e.holds).f)")
    ordered = struct(**{n: f"f.{n}" for n in ("no", "name", "item", "k", "line", "quoted")})
    df = _staged(df, ("kept",), hits=f"array_sort(transform(kept, f -> {ordered}))")
    return df.withColumn("hits", F.expr("""filter(hits, (h, i) -> i = 0 OR NOT (
        h.no = get(hits, i - 1).no AND h.name = get(hits, i - 1).name AND h.item = get(hits, i - 1).item))"""))


def _hit_columns(hit: str) -> list[str]:
    def by_name(index: int, show) -> str:
        return f"CASE {hit}.name " + " ".join(f"WHEN '{n}' THEN {show(v[index])}" for n, v in CHECKS.items()) + " END"

    words = {name: [c if name == "java_loop" else c.removesuffix("(") for c in calls] for name, calls in LOOP_CALLS.items()}
    word = f"CASE {hit}.name " + " ".join(
        f"WHEN '{name}' THEN get(array({', '.join(map(quote, shown))}), {hit}.k)" for name, shown in words.items()) + " ELSE '%s' END"
    return [
        f"{hit}.name AS check", f"{hit}.line AS line_number", f"{hit}.quoted AS quoted",
        by_name(1, quote) + " AS violation_type",
        by_name(2, lambda c: f"{c}D") + " AS confidence_score",
        f"replace({by_name(3, quote)}, '%s', {word}) AS description",
        f"shiftleft(cast({by_name(0, str)} as bigint), 32) + {hit}.line AS emit_ord",
    ]


def flow_hits(files: DataFrame, checks: tuple[str, ...] | None = None) -> DataFrame:
    """(file_path, check, line_number, quoted, description, ...) of the wanted checks, or of all."""
    return _with_hits(files, checks).select("file_path", "language", "platform", F.explode("hits").alias("h")).selectExpr(
        "file_path", "language", "platform", "h.no", *_hit_columns("h"))


def flow_violations(files: DataFrame, checks: tuple[str, ...] | None = None) -> DataFrame:
    """Flow hits as violation rows, with contexts from the untouched text of the file."""
    return (
        _with_hits(files, checks).where("size(hits) > 0")
        .select("file_path", "language", "platform", "hits", split_lines(F.col("content")).alias("lines"))
        .select("file_path", "language", "platform", F.expr("explode(transform(hits, h -> " + struct(
            h="h", context_before=context_before("h.line"), context_after=context_after("h.line")) + "))").alias("x"))
        .selectExpr("file_path", "language", "platform", "x.context_before", "x.context_after", *_hit_columns("x.h"))
        .select(
            "file_path", "line_number", F.substring("quoted", 1, 150).alias("line_content"),
            "violation_type", severity().alias("severity"), "platform",
            "language", F.concat(F.lit("[AST] "), F.col("description")).alias("description"),
            "context_before", "context_after", "confidence_score",
            F.lit(FLOW_ORD).alias("detector_ord"), "emit_ord",
        )
    )
