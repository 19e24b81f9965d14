"""A code corpus derived from the ``events`` table, the same in Spark and in plain SQL.

Every event is one line: event_id gives file, line number, block and position, user_id
goes into the text.  Forty lines make a file, eight files a repository, so the corpus
grows with the table.  Which snippet a block shows depends on the block number alone.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_FILE = 40
LINES_PER_BLOCK = 8
FILES_PER_REPO = 8
EXTENSIONS = (".cs", ".java", ".py", ".sql", ".xml")
FILLER = {
    ".cs": "    // step {u}",
    ".java": "    // step {u}",
    ".py": "    # step {u}",
    ".sql": "-- step {u}",
    ".xml": "<!-- step {u} -->",
}

# Per extension a list of snippets; a snippet is the lines at positions 1.. of its block.
# An empty string is a blank line, {u} becomes the user id.
SNIPPETS: dict[str, list[list[str]]] = {
    ".cs": [
        ['var cmd = new SqlCommand("SELECT * FROM t{u}", conn);'],
        ['var c = new SqlCommand("SELECT id FROM t{u} WHERE a=" + x, conn);',
         "c.CommandTimeout = 30;"],
        ["using (var s = new TransactionScope())"],
        ["foreach (var o in items) {", "    ctx.SaveChanges();", "}"],
        ["var m = new MongoClient(uri{u});"],
        ['var q = $"SELECT id FROM t{u} WHERE id = {id}";'],
        ["", "if (EXISTS (SELECT * FROM a)) return;", "// SELECT COUNT(*) FROM t{u}"],
        ['var q = string.Format("DELETE FROM t{u} WHERE a={0}", a);'],
        ['var q = "UPDATE t{u} SET a=" + b;',
         "using (var s = new TransactionScope(o, new TransactionOptions()))"],
        ["void Load{u}(string v) {", '  string sql = "SELECT id FROM user{u} WHERE a=" + v;',
         "  var k = new SqlCommand(sql, conn);", "}"],
        ['var cs = "server = db{u}";', 'var pw = "password = pw{u}";', "", "for (;;) {",
         "  Run(); ExecuteNonQuery();", "}"],
        ["var r = ctx.SqlQuery($\"SELECT id FROM t{u}\");",
         'var m = new MongoClient(u, ReadPreference.Nearest);', "NpgsqlConnection n{u};"],
        ["/* eval (x{u}) */", 'var e = "EXEC (a) + b";', "system(x{u});",
         "var k = new OracleCommand(t{u});"],
    ],
    ".java": [
        ['String q = "SELECT * FROM account{u}";'],
        ['em.createQuery("SELECT id FROM t{u} WHERE a=" + v);'],
        ["@Transactional", "void save{u}() { }"],
        ["for (Object o : items) {", "    em.persist(o);", "}"],
        ["Statement st = conn.createStatement();"],
        ["MongoClient c = MongoClient.create(uri{u});"],
        ["@Transactional(timeout = 30)", "", "String e = \"SELECT COUNT(*) FROM t{u}\";"],
        ['String f = String.format("INSERT INTO t{u} VALUES (%s)", v);'],
        ["void load{u}(String v) {", '  String sql = "SELECT id FROM loan{u} WHERE a=" + v;',
         "  st.executeQuery(sql);", "}"],
        ["Statement st = connection.createStatement();", "st.setQueryTimeout(5);",
         "OracleConnection oc{u};"],
        ["", "while (more) {", "  st.executeUpdate(u{u});", "}"],
        ["@Transactional(readOnly = true)", "void read{u}() { }",
         "MongoClientSettings.from(u{u}).readPreference(p);"],
        ["void run{u}() {", "  Statement s = conn.createStatement();",
         '  s.executeQuery("SELECT id FROM t{u} WHERE b=" + b);', "}",
         'String p = "${name{u}}";'],
    ],
    ".py": [
        ['cursor.execute(f"SELECT * FROM t{u} WHERE id = {uid}")'],
        ['cursor.execute("SELECT id FROM t{u} WHERE a=%s" % v)'],
        ["conn = psycopg2.connect(dsn{u})"],
        ["for o in items:", "    coll.insert_one(o)"],
        ["client = MongoClient(uri{u})"],
        ['password = "pw{u}"', 'api_key = "k{u}"', 'server = "db{u}"',
         "AKIA" + "ABCDEFGHIJKLMNOP", "token = t{u}", "-----BEGIN RSA PRIVATE KEY-----"],
        ["", 'cursor.execute("SELECT id FROM t{u} WHERE a = %s", (v,))',
         "conn = psycopg2.connect(dsn, connect_timeout=10)"],
        ["def load{u}(v):", '    sql = "SELECT id FROM t{u} WHERE a=" + v',
         "    return cursor.execute(sql)"],
        ['q = f"DELETE FROM customer{u} WHERE a = {a}"', "cursor.execute(q)"],
        ['db.query("UPDATE t{u} SET a=" + b)', "client = MongoClient(u, read_preference=p)"],
        ["while todo:", "    cursor.execute(todo.pop())", ""],
        ["conn = cx_Oracle.connect(dsn{u})", "eval(x{u})",
         "subprocess.run(c{u}, shell=True)"],
        ['rows = engine.execute("SELECT * FROM payment{u} WHERE a=" + a)',
         'obj.raw(f"SELECT id FROM t{u}")'],
    ],
    ".sql": [
        ["SELECT * FROM transaction{u}"],
        ["EXEC('SELECT id FROM t{u} WHERE a=' + @x)"],
        ["DECLARE cur{u} CURSOR FOR"],
        ["BEGIN TRANSACTION"],
        ["EXECUTE IMMEDIATE 'DELETE FROM t{u}' || v"],
        ["SET TRANSACTION ISOLATION LEVEL SERIALIZABLE", "BEGIN TRANSACTION"],
        ["SELECT COUNT(*) FROM t{u}", "DECLARE c{u} CURSOR FAST_FORWARD FOR"],
        ["BEGIN DISTRIBUTED TRANSACTION", "EXECUTE (\"DROP t{u}\" + @y)"],
        ["DECLARE d{u} CURSOR READ_ONLY FOR", "select *"],
        ["IF EXISTS (SELECT * FROM t{u}) PRINT 1", "SELECT (SELECT * ) FROM t{u}"],
        ["/* exec (x) */", "EXEC ('a' + b)"],
        ["declare e{u} cursor for", "", "begin transaction"],
        ["-- password: 'pw{u}'", "SELECT a.* FROM t{u}"],
    ],
    ".xml": [
        ["SELECT * FROM t{u} WHERE id = ${id}"],
        ["SELECT id FROM t{u} WHERE id = #{id}"],
        ["VALUES (#{a}, ${b})"],
        [],
        ["<select>SELECT * FROM loan{u}</select>"],
        [],
        [""],
        ["ORDER BY ${column} LIMIT {u}"],
        [],
        ["<!-- password='pw{u}' -->"],
        ["BEGIN TRANSACTION"],
        [],
        ["<sql>DECLARE x{u} CURSOR</sql>"],
    ],
}
N_SNIPPETS = len(SNIPPETS[".cs"])
assert all(len(v) == N_SNIPPETS for v in SNIPPETS.values())


def snippet_rows() -> list[tuple[str, int, int, str]]:
    return [
        (ext, s, p, text)
        for ext, snippets in SNIPPETS.items()
        for s, texts in enumerate(snippets)
        for p, text in enumerate(texts, 1)
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_from_ids(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """Code lines for a relation of (event_id, user_id)."""
    # a fixed literal table of a few hundred short rows: always small enough to broadcast
    snippets = F.broadcast(spark.createDataFrame(
        snippet_rows(), "ext string, snippet int, pos int, text string"))
    file_no = F.expr(f"event_id div {LINES_PER_FILE}")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]),
                       (file_no % len(EXTENSIONS) + 1).cast("int"))
    filler = F.lit(FILLER[EXTENSIONS[0]])
    for e in EXTENSIONS[1:]:
        filler = F.when(F.col("ext") == e, F.lit(FILLER[e])).otherwise(filler)
    numbered = ids.select(
        "user_id", file_no.alias("file_no"), ext.alias("ext"),
        (F.col("event_id") % LINES_PER_FILE + 1).cast("int").alias("line_number"),
        (F.expr(f"event_id div {LINES_PER_BLOCK}") % N_SNIPPETS).cast("int").alias("snippet"),
        (F.col("event_id") % LINES_PER_BLOCK).cast("int").alias("pos"),
    )
    repo = F.expr(f"file_no div {FILES_PER_REPO}").cast("string")
    text = F.replace(F.coalesce(F.col("text"), filler), F.lit("{u}"),
                     F.col("user_id").cast("string"))
    return numbered.join(snippets, ["ext", "snippet", "pos"], "left").select(
        F.concat(F.lit("repos/r"), repo).alias("repo"),
        F.concat(F.lit("repos/r"), repo, F.lit("/src/f"), F.col("file_no").cast("string"), "ext")
        .alias("file_path"),
        "file_no", "line_number", text.alias("line"),
    )


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_ids(spark, table(spark, sf_dir, "events").select("event_id", "user_id"))


def files_from_lines(lines: DataFrame) -> DataFrame:
    """Lines back to one row per file; a file has LINES_PER_FILE lines by construction."""
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "line")))
    return lines.groupBy("repo", "file_path").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_lines(corpus_lines(spark, sf_dir))


# --- the same corpus as SQL ----------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def corpus_sql() -> str:
    """CTEs ``code_lines(repo, file_path, ext, line_number, line)`` and ``code_files``."""
    values = ",\n".join(
        f"({_quoted(e)}, {s}, {p}, {_quoted(t)})" for e, s, p, t in snippet_rows())
    exts = ", ".join(_quoted(e) for e in EXTENSIONS)
    filler = " ".join(f"WHEN {_quoted(e)} THEN {_quoted(t)}" for e, t in FILLER.items())
    return f"""
snippets(ext, snippet, pos, txt) AS (VALUES {values}),
numbered AS (
  SELECT user_id, event_id // {LINES_PER_FILE} AS file_no,
         ([{exts}])[(event_id // {LINES_PER_FILE}) % {len(EXTENSIONS)} + 1] AS ext,
         CAST(event_id % {LINES_PER_FILE} + 1 AS INTEGER) AS line_number,
         (event_id // {LINES_PER_BLOCK}) % {N_SNIPPETS} AS snippet,
         event_id % {LINES_PER_BLOCK} AS pos
  FROM events),
code_lines AS (
  SELECT 'repos/r' || CAST(n.file_no // {FILES_PER_REPO} AS VARCHAR) AS repo,
         'repos/r' || CAST(n.file_no // {FILES_PER_REPO} AS VARCHAR) || '/src/f'
           || CAST(n.file_no AS VARCHAR) || n.ext AS file_path,
         n.ext, n.line_number,
         replace(coalesce(s.txt, CASE n.ext {filler} END), '{{u}}', CAST(n.user_id AS VARCHAR)) AS line
  FROM numbered n LEFT JOIN snippets s
    ON s.ext = n.ext AND s.snippet = n.snippet AND s.pos = n.pos),
code_files AS (
  SELECT repo, file_path, ext, string_agg(line, chr(10) ORDER BY line_number) AS content
  FROM code_lines GROUP BY repo, file_path, ext)"""
