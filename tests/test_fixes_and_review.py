import fnmatch
import json

import pytest
from pyspark.sql import functions as F

from lintlake.operators import fixes, replies, review, scan
from lintlake.operators.manifest import items, match, recall, summary_check

S, C, U, L, R = ("SELECT_STAR", "STRING_CONCAT_SQL", "UNBATCHED_TXN", "LONG_RUNNING_TXN", "READ_PREFERENCE")
COLUMNS = ("file_path string, line_number int, line_content string, violation_type string, severity string, "
           "platform string, language string, description string, context_before array<string>, "
           "context_after array<string>, confidence_score double, detector_ord int, emit_ord int")


def violations(spark, rows):
    """rows of (path, line, text, type, language)"""
    ords = {S: 1, C: 2, U: 3, L: 4, R: 5}
    return spark.createDataFrame([
        (p, n, t, v, "CRITICAL" if v == C else "HIGH", "MSSQL", lang, "d", ["before"], ["after"], 0.9, ords[v], n)
        for p, n, t, v, lang in rows], COLUMNS)


@pytest.mark.parametrize("text, vtype, language, fixed", [
    ('q("SELECT * FROM Accounts")', S, "JAVA",
     'q("SELECT account_id, account_number, customer_id, balance, status FROM Accounts")'),
    ("select  * from x", S, "SQL", "SELECT id, name, status, created_date from x"),
    ("SELECT * FROM user_payments", S, "SQL",
     "SELECT payment_id, amount, from_account, to_account, status, processed_date FROM user_payments"),
    ("WHERE id = ${id} AND x = ${a.b}", C, "JAVA", "WHERE id = #{id} AND x = ${a.b}"),
    ('q = "a" + b', C, "JAVA", 'q = "a" + b  // FIX: Use PreparedStatement with ? placeholders'),
    ("""x = "id='" + id + "'";""", C, "C#", '''x = "id='" -- Use: cmd.Parameters.AddWithValue("@param", id)\'";'''),
    ('$"SELECT {x}"', C, "C#", '$"SELECT {x}"  // FIX: Use parameterized query with cmd.Parameters.AddWithValue()'),
    ('execute(f"SELECT {x} FROM t")', C, "PYTHON", 'execute("SELECT %s FROM t", (x,))'),
    ("execute(f'a {x}', 'b')", C, "PYTHON", "execute('a %s', (x,), 'b')"),
    ('execute("a" + b)', C, "PYTHON", 'execute("a" + b)  # FIX: Use parameterized query: cursor.execute(sql, (param,))'),
    ("exec('a' + b)", C, "SQL",
     "exec('a' + b)  -- FIX: Use sp_executesql with parameters instead of EXEC with concatenation"),
    ("x", C, "SQL", "x  // FIX: Use parameterized queries instead of string concatenation"),
    ("for o", U, "SQL", "for o  -- FIX: Use batch operations"),
    ("@Transactional", L, "JAVA", "@Transactional(timeout = 30)"),
    ("connect(a(b))", L, "PYTHON", "connect(a(b, connect_timeout=10), connect_timeout=10)"),
    ("new TransactionScope()", L, "C#",
     "new TransactionScope(TransactionScopeOption.Required, new TransactionOptions { Timeout = TimeSpan.FromSeconds(30) })"),
    ("BEGIN", L, "SQL", "BEGIN  // FIX: Add timeout configuration"),
    ("MongoClient(u)", R, "PYTHON", "MongoClient(\n    read_preference=ReadPreference.SECONDARY_PREFERRED,\n    u)"),
])
def test_template(spark, text, vtype, language, fixed):
    row = fixes.template_fixes(violations(spark, [("f", 1, text, vtype, language)])).first()
    assert row.fixed_code == fixed and row.security_review_passed and row.ai_model_used == "template-engine"


def test_unknown_type_gives_an_empty_fix(spark):
    df = violations(spark, [("f", 1, "x", S, "SQL")]).withColumn("violation_type", F.lit("OTHER"))
    row = fixes.template_fixes(df).first()
    assert (row.fixed_code, row.fix_confidence, row.security_review_passed) == ("", 0.0, False)
    assert row.security_review_notes == "No template available for this violation type"


def test_batch_takes_critical_first_then_one_per_new_type(spark):
    rows = [("b", n, "x", C, "JAVA") for n in range(1, 4)] + [("a", n, "x", S, "JAVA") for n in (5, 4)]
    rows += [("c", 1, "x", L, "JAVA"), ("a", 9, "x", L, "JAVA")]
    got = [(r.file_path, r.line_number) for r in fixes.select_batch(violations(spark, rows)).collect()]
    assert got == [("b", 1), ("b", 2), ("b", 3), ("a", 4), ("a", 9)]
    many = violations(spark, [("b", n, "x", C, "JAVA") for n in range(30, 0, -1)])
    assert [r.line_number for r in fixes.select_batch(many).collect()] == list(range(1, 11))


@pytest.mark.parametrize("apply, once", [(fixes.apply_first, True), (fixes.apply_all, False)])
def test_apply_is_an_ordered_fold(spark, apply, once):
    files = spark.createDataFrame([("f", "a $1 b\nab a $1\nc"), ("g", "untouched")], "file_path string, content string")
    steps = [("a $1", "b{x}"), ("b", "\\1"), ("zz", "y"), ("b", "")]
    df = violations(spark, [("f", i, "x", S, "SQL") for i in range(len(steps))])
    pairs = spark.createDataFrame([(i, o, n) for i, (o, n) in enumerate(steps)], "line_number int, original_code string, fixed_code string")
    got = apply(files, df.join(pairs, "line_number")).collect()
    text, applied = "a $1 b\nab a $1\nc", 0
    for old, new in steps:
        if new == "":
            continue
        if once:
            if old in text:
                text, applied = text.replace(old, new, 1), applied + 1
        else:
            text, applied = text.replace(old, new), applied + 1
    assert [(r.file_path, r.content, r.applied) for r in got] == [("f", text, applied)]


def test_globs_match_like_fnmatch(spark):
    globs = ["*.java", "src/*", "src/?.py", "[ab]*.cs", "[!ab]*.cs", "*[.]sql", "a+b(c).py", "[x", "src/**/t.py"]
    paths = ["src/a.java", "a.cs", "c.cs", "src/x.py", "src/xx.py", "d/q.sql", "a+b(c).py", "[x", "src/a/b/t.py", "x\n.java"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    for glob in globs:
        col = review.reviewer_for_path([(glob, "hit")], "none")
        for row in df.select("file_path", col.alias("r")).collect():
            assert (row.r == "hit") == fnmatch.fnmatchcase(row.file_path, glob), (glob, row.file_path)


def test_first_glob_wins_and_default_applies(spark):
    df = violations(spark, [("src/a.py", 1, "x", S, "PYTHON"), ("z", 1, "x", C, "SQL")])
    rules = [("src/*", "first"), ("*.py", "second")]
    assert sorted(r[0] for r in df.select(review.reviewer_for_path(rules)).collect()) == ["first", "security-team"]
    assert review.pr_reviewers(df, rules).first().reviewers == "first,security-team"
    by_type = df.select(F.explode(review.reviewers_for_type({C: ["a", "b"]}))).collect()
    assert sorted(r[0] for r in by_type) == ["a", "b", "security-team"]


def test_pull_request_texts(spark):
    v = violations(spark, [("p/a.sql", 3, "SELECT * FROM t", S, "SQL"), ("p/b.sql", 1, "EXEC('a' + b)", C, "SQL")])
    fx = fixes.template_fixes(v)
    plan = review.pr_plan(fx).first()
    assert plan.title == "DB Hygiene: Fix 2 violations (SELECT_STAR, STRING_CONCAT_SQL)"
    assert plan.is_draft is False or abs((0.85 + 0.9) / 2 - 0.85) > 0
    with pytest.raises(ValueError):
        review.pr_body(fx)
    with pytest.raises(ValueError):
        replies.prompt_pr_description(fx)
    whole = review.pr_body(fx.withColumn("k", F.lit(1)), "k", generator="me").first()
    body = whole.body
    assert (whole.part, whole.parts) == (1, 1)
    assert "addresses **2** database" in body and "| p/a.sql:3 | SELECT_STAR | 85% |\n| p/b.sql:1 | STRING_CONCAT_SQL | 90% |\n" in body
    assert body.endswith("*Generated by me*\n")
    pieces = review.pr_body_lines(fx, generator="me").orderBy("part", "ord").collect()
    assert "".join(r.text for r in pieces) == body
    comment = review.pr_comment(scan.type_counts(v)).first().body
    assert "**2 violation(s) detected**" in comment and comment.index(S) < comment.index(C)
    none = review.pr_comment(scan.type_counts(v.where("false"))).first().body
    assert "No violations detected." in none


REPLIES = [
    ('{"a": "x"}', '{"a":"x"}'), (' {"a": 1} ', '{"a":1}'), ('```json\n{"a": 2}\n```', '{"a":2}'),
    ('So:\n```\n{"a": 3}\n```', '{"a":3}'), ('Here {"a": {"b": 4}} ok', '{"a":{"b":4}}'),
    ("nothing", None), ("{'a': 1}", None), ('```json\n{bad}\n```\n{"a": 5', None), ("[1, 2]", "[1,2]"), ("", None),
]


def test_reply_ladder(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(REPLIES)], "i int, c string")
    got = [r[1] for r in sorted(df.select("i", replies.parse_json(F.col("c"))).collect())]
    for (content, want), out in zip(REPLIES, got):
        assert (None if out is None else json.loads(out)) == (None if want is None else json.loads(want)), content


def test_replies_flow_into_fixes(spark):
    v = violations(spark, [("f", n, f"line {n}", S, "SQL") for n in range(1, 6)])
    ids = {r.line_number: r.violation_id for r in replies._with_id(v).collect()}
    schema = "violation_id string, kind string, content string, error string"
    fix = spark.createDataFrame([
        (ids[1], "fix", '{"fixed_code": "ok", "explanation": "e", "confidence_score": 0.9}', None),
        (ids[2], "fix", '{"fixed_code": "eval(x)", "confidence_score": 0.5}', None),
        (ids[3], "fix", "[1]", None), (ids[4], "fix", "", "down")], schema)
    rows = {r.line_number: r for r in replies.merge_fixes(v, fix).collect()}
    assert (rows[1].fixed_code, rows[1].security_review_notes) == ("ok", "Passed basic validation")
    assert not rows[2].security_review_passed and "eval()" in rows[2].security_review_notes
    assert rows[3].fixed_code == "" and rows[3].security_review_notes.startswith("Error: ")
    assert rows[4].security_review_notes == "Error: down" and rows[5].fixed_code == ""
    check = spark.createDataFrame([
        (ids[1], "review", '{"approved": true, "review_notes": "n", "issues": [{"issue": "i"}]}', None)], schema)
    out = replies.merge_reviews(replies.merge_fixes(v, fix), check)
    rows = {r.line_number: r for r in out.collect()}
    assert rows[1].security_review_passed and rows[1].security_review_notes == "n Issues: UNKNOWN: i"
    assert rows[3].security_review_notes == "No fixed code to review"
    assert [r.line_number for r in replies.run(v, None, fix, check).collect()] == [1]
    assert replies.run(v, None, fix, None).count() == 5
    stats = replies.run_stats(v, replies.merge_fixes(v, fix), replies.run(v, None, fix, check)).first()
    assert tuple(stats) == (5, 2, 1, 4)


def test_prompts_mask_the_snippet_but_not_the_context(spark):
    v = violations(spark, [("f", 1, 'password = "x9"', S, "SQL")])
    prompt = replies.prompt_classify(v).first().prompt
    assert "***REDACTED***" in prompt and 'before\npassword = "x9"\nafter' in prompt and "{violation_type}" not in prompt
    assert replies.prompt_review(fixes.dry_run_fixes(v)).count() == 0


def test_manifest(spark):
    doc = spark.sql("""select array(named_struct('violation_id', 'V1', 'file', 'f', 'violation_type', 'SELECT_STAR',
        'database_platform', 'MSSQL', 'language', 'SQL', 'line_range', '3-5', 'code_snippet', '', 'severity', 'HIGH',
        'banking_context', ''), named_struct('violation_id', 'V2', 'file', 'f', 'violation_type', 'NO_TIMEOUT',
        'database_platform', 'MSSQL', 'language', 'SQL', 'line_range', '9', 'code_snippet', '', 'severity', 'HIGH',
        'banking_context', '')) violations, map('SELECT_STAR', 2L, 'GONE', 1L) violation_type_summary,
        map('HIGH', 2L) severity_summary, map('MSSQL', 2L) platform_summary""")
    check = {r.value: r.difference for r in summary_check(doc).collect()}
    assert check == {"SELECT_STAR": 1, "GONE": 1, "NO_TIMEOUT": -1, "HIGH": 0, "MSSQL": 0}
    matched = match(items(doc), violations(spark, [("f", 5, "x", S, "SQL"), ("f", 5, "x", L, "SQL")]))
    assert {r.violation_id: r.matched for r in matched.collect()} == {"V1": True, "V2": False}
    assert {(r.mapped_type, r.expected, r.found) for r in recall(matched).collect()} == {(S, 1, 1), (L, 1, 0)}
