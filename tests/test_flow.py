"""Statement, scope and flow checks on hand-written sources."""

import pytest

from lintlake.operators import flow

JAVA = '''package a;
class Repo {
  // executeQuery(sql) in a comment does not matter for blocks { {
  private String none = "SELECT * FROM x" + y;
  void load(String v) {
    String sql =
        "SELECT id FROM t WHERE a = '"
        + v + "'";
    if (v != null) {
      try (Statement st = new Fast(conn)) {
        st.executeQuery(sql);
      }
    }
  }
  void other(String v) {
    String sql = "SELECT id FROM t WHERE a = " + v;
    log(sql);
  }
  void calls(String v) {
    conn.prepareStatement(
        "DELETE FROM t WHERE a = " + v).execute();
    conn.prepareStatement("DELETE FROM t WHERE a = ?");
  }
  @Transactional(readOnly = true)
  void saveAll(List<A> items) {
    for (int i = 0; i < 3; i++) {
      String brace = "}";
      em.persist(items.get(i));
    }
    while (more) log("no call");
    for (A a : items) session.saveOrUpdate(a);
    do { x(); } while (more);
  }
  @Transactional
  void plain() {
    Statement st = conn.createStatement();
    st.executeQuery("SELECT COUNT(*) FROM t");
  }
  @Transactional(timeout = 3)
  void fine() {
    Statement st = conn.createStatement();
  }
}
'''
PY = '''import x
def load(uid):
    """SELECT * FROM doc"""
    query = (
        "SELECT id FROM t WHERE id = %s" % uid)
    sql = "SELECT id FROM t WHERE id = " + uid
    lone = "SELECT id FROM t WHERE id = " + uid
    def inner():
        cursor.execute(sql)
    db.query(query)

def other():
    cursor.execute(lone)
    cursor.execute(f"""SELECT id
        FROM t WHERE a = {a}""")
    cursor.execute("SELECT id FROM t", f(1))

for row in rows:
    if row:
        # comment
        session.add(row)
print("done")
for row in rows: cursor.execute(row)
while True:
    log(row)
client = MongoClient(
    uri,
    tz_aware=True,
)
ok = MongoClient(uri, read_preference=p)
conn = psycopg2.connect(
    dsn)
conn = pymysql.connect(dsn, connect_timeout=3)
top = "UPDATE t SET a = {}"
cursor.executemany(top_level, rows)
session.execute(text(top))
# MongoClient(in_comment)
'''
CS = '''namespace N {
class Svc {
  string P { get; set; }
  void Load(string v) {
    var sql = "SELECT id FROM t WHERE a = " + v;
    using (var cmd = new SqlCommand(sql, conn)) {
      cmd.ExecuteReader();
    }
    string path = @"c:\\dir\\";
    string q = $"UPDATE t SET a = {v}";
    string plain = $"no statement {v}";
  }
  void Timed() {
    var cmd = new OracleCommand("SELECT 1");
    if (x) { cmd.CommandTimeout = 3; }
  }
  void Loops() {
    foreach (var i in items) {
      if (i.Ok) { ctx.SaveChangesAsync(); }
    }
    if (x)
      for (int k = 0; k < 3; k++) { Log(k); }
    while (r.Read()) Execute(r);
  }
  void Scope() {
    using (var s = new TransactionScope()) { }
    using (var s = new TransactionScope(o, new TransactionOptions { Timeout = t })) { }
    var star = @"SELECT
      * FROM t";
  }
}
}
'''


@pytest.fixture(scope="module")
def hits(spark):
    files = spark.createDataFrame([("R.java", JAVA), ("r.py", PY), ("r.cs", CS)], "file_path string, content string")
    rows = flow.flow_hits(files).collect()
    out = {}
    for r in rows:
        out.setdefault(r.check, []).append((r.line_number, r.description, r.quoted))
    return {k: sorted(v) for k, v in out.items()}


def at(hits, check):
    return [line for line, _, _ in hits.get(check, [])]


@pytest.mark.parametrize("check, lines", [
    ("java_sql_var", [6]),
    ("java_concat_call", [20]),
    ("java_loop", [26, 31]),
    ("java_transactional", [34]),
    ("java_transactional_args", [24]),
    ("java_stmt_prepared", [36]),
    ("java_select_star", [4]),
    ("py_sql_var", [4, 6, 34]),
    ("py_fstring", [14]),
    ("py_loop", [18, 23]),
    ("py_mongo", [26]),
    ("py_connect", [31]),
    ("py_select_star", [3]),
    ("cs_sql_var", [5]),
    ("cs_interpolated", [10]),
    ("cs_loop", [18, 23]),
    ("cs_txnscope", [26]),
    ("cs_cmd_timeout", [6]),
    ("cs_select_star", [28]),
])
def test_check(hits, check, lines):
    assert at(hits, check) == lines


def test_loop_names_first_listed_call_and_quotes_the_loop(hits):
    line, text, quoted = hits["java_loop"][0]
    assert text.startswith("N+1 query: em.persist called") and quoted.startswith("for (int i = 0; i < 3")
    assert hits["java_loop"][1][2] == "for (A a : items) session.saveOrUpdate(a);"
    assert hits["py_loop"][0][1].startswith("N+1 query: session.add called")
    assert hits["py_loop"][0][2].endswith("session.add(row)")
    assert hits["cs_loop"][0][1].startswith("N+1 query: SaveChangesAsync inside loop")


def test_mask_keeps_length_and_line_breaks(spark):
    texts = [("a.java", JAVA), ("a.py", PY), ("a.cs", CS)]
    files = spark.createDataFrame(texts, "file_path string, content string")
    for row in flow.code_mask(files).collect():
        original = dict(texts)[row.file_path]
        assert len(row.code) == len(original)
        assert [i for i, c in enumerate(row.code) if c == "\n"] == [i for i, c in enumerate(original) if c == "\n"]
        assert "SELECT" not in row.code and "comment" not in row.code


def test_mask_agrees_with_pythons_own_tokenizer(spark):
    import io
    import tokenize

    row = flow.code_mask(spark.createDataFrame([("a.py", PY)], "file_path string, content string")).first()
    lines = row.code.split("\n")
    for tok in tokenize.generate_tokens(io.StringIO(PY).readline):
        if tok.type in (tokenize.NAME, tokenize.NUMBER):
            (r, c), (_, end) = tok.start, tok.end
            if tok.string == "a" and "{a}" in tok.line:
                continue  # inside an f-string
            assert lines[r - 1][c:end] == tok.string


def test_python_statements_agree_with_ast(spark):
    import ast

    df = flow.statements(spark.createDataFrame([("a.py", PY)], "file_path string, content string"))
    got = {r.line for r in df.collect()}
    want = {n.lineno for n in ast.walk(ast.parse(PY)) if isinstance(n, ast.stmt)}
    assert got >= want - {next(i for i, t in enumerate(PY.split("\n"), 1) if t.startswith("for row in rows: "))}


def test_python_scopes_agree_with_ast(spark):
    import ast

    source = "\n".join([
        "def a():", "    x = 1", "    def b():", "        y = 2", "    z = 3", "", "class C:",
        "    def m(self):", "        if 1:", "            w = 4", "    k = 5", "def d(): pass", "q = 6  # execute"])
    files = spark.createDataFrame([("a.py", source)], "file_path string, content string")
    df = flow.placed_statements(files)
    line_of = {r.no: r.line for r in df.collect()}
    got = {r.line: line_of.get(r.scope_no) for r in df.collect()}
    want = {}

    def visit(node, scope):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.stmt):
                want[child.lineno] = scope
            visit(child, child.lineno if isinstance(child, ast.FunctionDef) else scope)

    visit(ast.parse(source), None)
    want[12] = None  # a header belongs to the scope around it
    assert got == want


def test_emitted_rows(spark):
    files = spark.createDataFrame([("R.java", JAVA)], "file_path string, content string")
    rows = flow.flow_violations(files, ("java_sql_var",)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row.description.startswith("[AST] SQL injection") and row.severity == "CRITICAL"
    assert row.context_before[-1] == "  void load(String v) {" and len(row.context_after) == 3
    assert len(row.line_content) <= 120
