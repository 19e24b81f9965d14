"""Each line rule on positive and negative lines, windows, suppression and file effects."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lintlake.operators import rules, scan
from lintlake.operators.secondary import secondary_hits

# (file suffix, text, {(line, type), ...})
S, C, U, L, R = ("SELECT_STAR", "STRING_CONCAT_SQL", "UNBATCHED_TXN", "LONG_RUNNING_TXN",
                 "READ_PREFERENCE")
CASES = [
    (".sql", "SELECT * FROM users;", {(1, S)}),
    (".sql", "SELECT COUNT(*) FROM users;", set()),
    (".sql", "IF EXISTS(SELECT * FROM t) BEGIN END", set()),
    (".sql", "SELECT id, name FROM users;", set()),
    (".sql", "x := (SELECT * )", set()),
    (".sql", "select *", {(1, S)}),
    (".sql", "ſelect * from t", {(1, S)}),      # long s folds to s
    (".py", '"SELECT * FROM a"\n"SELECT * FROM b"\n"SELECT * FROM c"', {(1, S), (2, S), (3, S)}),
    (".py", 'cursor.execute(f"SELECT id FROM users WHERE id = {user_id}")', {(1, C)}),
    (".py", 'cursor.execute("SELECT id FROM users WHERE id = %s", (user_id,))', set()),
    (".py", 'cursor.execute("SELECT id FROM t WHERE a=%s" % v)', {(1, C)}),
    (".py", 'q = f"DELETE FROM t WHERE a = {a}"', {(1, C)}),
    (".py", "conn = psycopg2.connect(dsn)", {(1, L)}),
    (".py", "conn = psycopg2.connect(dsn, connect_timeout=3)", set()),
    (".py", "c = MongoClient(uri)", {(1, R)}),
    (".py", "c = MongoClient(uri, readPreference=x)", set()),
    (".py", "for o in items:\n    coll.insert_one(o)", {(1, U)}),
    (".cs", '$"SELECT id FROM users WHERE id = {userId}"', {(1, C)}),
    (".cs", 'string.Format("DELETE FROM t WHERE a={0}", a)', {(1, C)}),
    (".cs", "new TransactionScope()", {(1, L)}),
    (".cs", "new TransactionScope()\n\n// Timeout", set()),
    (".cs", "new TransactionScope()\n\n// timeout", {(1, L)}),     # case counts
    (".cs", "a\nb\nc\nd\n// Timeout\ne\nf\nnew TransactionScope()", {(8, L)}),  # three lines up is too far
    (".cs", "new SqlCommand(q, c);\ncmd.CommandTimeout = 3;", set()),
    (".cs", "new SqlCommand(q, c);", {(1, L)}),
    (".cs", "new TransactionScope() new SqlCommand(q)\n// CommandTimeout", set()),
    (".cs", "var m = new MongoClient(u);", {(1, R)}),
    (".java", "@Transactional", {(1, L)}),
    (".java", "@Transactional(timeout = 3)", set()),
    (".java", "Statement s = conn.createStatement();", {(1, L)}),
    (".java", "Statement s = conn.createStatement();\ns.setQueryTimeout(3);", set()),
    (".java", "MongoClient.create(u)", {(1, R)}),
    (".java", 'String.format("SELECT id FROM t WHERE a=%s", v)', {(1, C)}),
    (".xml", "WHERE loan_id = ${loanId}", {(1, C)}),
    (".xml", "WHERE loan_id = #{loanId}", set()),
    (".sql", "EXEC('SELECT id FROM users WHERE id = ' + @id)", {(1, C)}),
    (".sql", "EXECUTE IMMEDIATE 'DELETE FROM t' || v", {(1, C)}),
    (".sql", "DECLARE c CURSOR FOR", {(1, L)}),
    (".sql", "DECLARE c CURSOR READ_ONLY FOR", set()),
    (".sql", "DECLARE c CURSOR fast_forward FOR", set()),
    (".sql", "BEGIN TRANSACTION", {(1, L)}),
    (".sql", "set transaction isolation level x\nBEGIN TRANSACTION", set()),
    (".PY", "for o in items:\n    coll.insert_one(o)", set()),        # routed as Python, ruled as SQL
    (".txt", "SELECT * FROM t", set()),
]


@pytest.fixture(scope="module")
def case_hits(spark):
    files = spark.createDataFrame(
        [(f"case{i}{suffix}", text) for i, (suffix, text, _) in enumerate(CASES)],
        "file_path string, content string")
    found = {}
    for row in scan.scan_lines(files).collect():
        found.setdefault(row.file_path, set()).add((row.line_number, row.violation_type))
    return found


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(case_hits, i):
    suffix, text, expected = CASES[i]
    assert case_hits.get(f"case{i}{suffix}", set()) == expected, text


LOOP = "for (Object o : items) {\n    em.persist(o);\n}"


def test_loop_reports_first_line_of_window_per_ten_lines(corpus):
    text = "\n".join([f"// l{i}" for i in range(1, 36)] + [LOOP])
    rows = scan.scan_lines(corpus({"A.java": text})).where(f"violation_type = '{U}'")
    # the loop is at line 36: windows from 22 on reach its call at line 37
    assert sorted(r.line_number for r in rows.collect()) == [22, 30]


def test_blank_reported_line_discards_the_file(corpus):
    text = "\n" + LOOP
    assert scan.scan_lines(corpus({"A.java": text})).count() == 0
    assert scan.scan_lines(corpus({"A.java": text}), strict_blank=False).count() == 1


def test_contexts_are_clipped(corpus):
    text = "a\nb\nSELECT * FROM t\nc"
    row = scan.scan_lines(corpus({"x.sql": text})).first()
    assert row.context_before == ["a", "b"] and row.context_after == ["c"]
    assert row.line_content == "SELECT * FROM t" and row.severity == "HIGH"


def test_languages_and_platforms_differ_by_detector(corpus):
    text = "import cx_Oracle\nSELECT * FROM t WHERE a = ${b} -- pymongo\nBEGIN TRANSACTION"
    rows = {(r.violation_type): r for r in scan.scan_lines(corpus({"m.xml": text})).collect()}
    assert rows[S].language == "SQL" and rows[C].language == "JAVA"
    assert rows[S].platform == "MONGODB" and rows[L].platform == "ORACLE"


def test_statistics_add_up(spark, corpus):
    files = corpus({"a.sql": "SELECT * FROM t\nBEGIN TRANSACTION", "b.py": "x = 1", "c.txt": "SELECT * FROM t"})
    v = scan.scan_lines(files)
    totals = scan.totals(files, v).first()
    assert (totals.total_files_scanned, totals.total_violations) == (2, 2)
    for facet, n in scan.all_facets(v).groupBy("facet").sum("n").collect():
        assert n == 2, facet
    gate = {r.file_path: r.approval_required for r in scan.gate_decision(files, v).collect()}
    assert gate == {"a.sql": True, "b.py": False, "c.txt": False}


def test_dedup_is_idempotent_and_keeps_the_first(spark):
    rows = [("f", S, 1, 6, 2), ("f", S, 1, 1, 9), ("f", S, 1, 6, 1), ("f", C, 1, 2, 1)]
    df = spark.createDataFrame(rows, "file_path string, violation_type string, line_number int, detector_ord int, emit_ord int")
    once = scan.dedup(df)
    assert sorted(map(tuple, once.collect())) == [("f", S, 1, 1, 9), ("f", C, 1, 2, 1)][::-1] or \
        sorted(map(tuple, once.collect())) == sorted([("f", S, 1, 1, 9), ("f", C, 1, 2, 1)])
    assert sorted(map(tuple, scan.dedup(once).collect())) == sorted(map(tuple, once.collect()))


def test_secondary_pack_emits_every_rule(corpus):
    files = corpus({
        "a.cs": '$"SELECT * FROM t {x}"\nnew SqlCommand(q)\n\n\n\n\nx',
        "b.java": "Statement s = em.createQuery(q)",
        "c.java": "Statement s = em.createQuery(q); s.setQueryTimeout(3)",
    })
    got = sorted((r.file_path, r.line_number, r.violation_type) for r in secondary_hits(files).collect())
    assert got == sorted([
        ("a.cs", 1, S), ("a.cs", 1, C), ("a.cs", 2, L), ("b.java", 1, C), ("b.java", 1, L), ("c.java", 1, C)])


PATTERNS = sorted({p for r in rules.RULES for p in r.any_of + r.none_of + r.after})
WORDS = ["SELECT", "select", "ſelect", " ", "  ", "*", "(", ")", "'", '"', "+", "f", "$", "{", "}", "%s", "%",
         "execute", "SqlCommand", "new", "TransactionScope", "COUNT", "EXISTS", "DECLARE", "c", "CURSOR",
         "FAST_FORWARD", "BEGIN", "TRANSACTION", "EXEC", "createQuery", "||", "IMMEDIATE", "é", "K", "\t", "\u00a0"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from(WORDS), max_size=9).map("".join), min_size=40, max_size=40))
def test_patterns_mean_the_same_as_in_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")
    exprs = [rules.search("line", p) + f" AS p{k}" for k, p in enumerate(PATTERNS)]
    for row in df.selectExpr("line", *exprs).collect():
        for k, p in enumerate(PATTERNS):
            assert row[f"p{k}"] == bool(re.search(p, row.line, re.I)), (p, row.line)


def test_gate_never_loses_a_match(spark, sf):
    """Rules on all lines, without the word gate, find the same."""
    from pyspark.sql import functions as F

    from lintlake.plans.corpus import corpus_files

    files = corpus_files(spark, sf).cache()
    gated = {(r.file_path, r.line_number, r.violation_type) for r in scan.scan_lines(files).collect()}
    all_lines = (
        scan.with_file_columns(files).withColumn("lines", F.split("content", "\n", -1))
        .selectExpr("*", "posexplode(lines) AS (p, line)").selectExpr(
            "*", "array_join(slice(lines, greatest(p - 1, 1), p + 6 - greatest(p - 1, 1) + 1), '\\n') AS w_m2_5"))
    full = set()
    for rule in rules.RULES:
        vtype = rules.DETECTORS[rule.detector].violation_type
        full |= {(r.file_path, r.p + 1, vtype) for r in all_lines.where(rules.rule_condition(rule)).collect()}
    assert full == {g for g in gated if g[2] != U}
