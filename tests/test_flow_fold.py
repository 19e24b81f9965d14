"""Chains, deep brackets and odd text through the file-local fold."""

import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import flow, scan

N = 20_000


def hits(spark, name, content, checks=None):
    files = spark.createDataFrame([(name, content)], "file_path string, content string")
    return [(r.check, r.line_number, r.quoted) for r in flow.flow_hits(files, checks).collect()]


def java(body):
    return "class A { void f() { " + body + " } }"


@pytest.mark.parametrize("name, content, found", [
    ("a.java", java("String s = b" + ".and(x)" * N + '.executeQuery("select " + x);'), ["java_concat_call"]),
    ("b.java", java("sb" + '.append("select a" + b)' * N + ";"), []),
    ("c.java", java('st.execute("select a"' + ' + b + "c"' * N + ");"), ["java_concat_call"]),
    ("d.java", java("st.execute(x" + ' + b + "c"' * N + ");"), []),
    ("e.java", java("st.execute(" + "f(" * N + "1" + ")" * N + ' + "select ");'), ["java_concat_call"]),
    ("f.java", java("if (a) x(); else " * N + "while (a) em.persist(b);"), ["java_loop"]),
    ("g.py", "q = db" + ".filter(x)" * N + '.execute(f"select {x}")\n', ["py_fstring"]),
    ("h.py", "c = MongoClient(x)" + ".db(y)" * N + "\n", ["py_mongo"]),
    ("i.py", "x = a" + ".b" * N + ".connect(y)\n", []),
    ("j.cs", "class A { void F() { var c = new SqlCommand(x" + ", y" * N + "); } }", ["cs_cmd_timeout"]),
])
def test_generated_code_ends_no_executor(compiled, name, content, found):
    assert [c for c, _, _ in hits(compiled, name, content)] == found


def test_every_call_of_a_long_chain_is_found(compiled):
    got = hits(compiled, "a.java", java("b" + '\n.execute("select " + x)' * 2000 + ";"), ("java_concat_call",))
    assert sorted(line for _, line, _ in got) == [1] + list(range(3, 2002))
    assert {q for _, line, q in got if line > 1} == {'execute("select " + x)'}


def test_receivers_and_nested_calls(spark):
    body = ('a.b(c(1), ")").d . execute("SELECT " + f(2)).g();\n'
            'log(conn.prepareStatement("DELETE FROM t WHERE a = " + v));\n'
            '(x).execute("SELECT " + y);\n'
            'st.execute(conn.prepareStatement("SELECT " + z));\n'
            'return q.createQuery(\n"SELECT " + w);')
    got = sorted(hits(spark, "a.java", java(body), ("java_concat_call",)), key=lambda h: h[1])
    assert [(line, q) for _, line, q in got] == [
        (1, 'a.b(c(1), ")").d . execute("SELECT " + f(2))'), (2, 'conn.prepareStatement("DELETE FROM t WHERE a = " + v)'),
        (3, 'execute("SELECT " + y)'), (4, 'st.execute(conn.prepareStatement("SELECT " + z))'),
        (5, 'q.createQuery(\n"SELECT " + w)')]


def test_pairs_agree_with_a_stack(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.() \n") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    marked = [t.replace("(", "(\x02").replace(")", ")\x02") for t in texts]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(marked)], "i int, m string")
    got = {r.i: {(p.o, p.c, p.level) for p in r.pairs} for r in df.select("i", F.expr(
        flow.let(flow._pieces("m"), flow._pairs)).alias("pairs")).collect()}
    for i, text in enumerate(texts):
        stack, want = [], set()
        for n, c in enumerate((c for c in text if c in "()"), 1):
            if c == "(":
                stack.append(n)
            elif stack:
                level = len(stack)
                want.add((stack.pop(), n, level))
        assert got[i] == want


def test_running_pass_equals_a_loop(spark):
    df = spark.createDataFrame([(n, list(range(n))) for n in (0, 1, 63, 64, 65, 128, 1000, 5001)], "n int, a array<int>")
    sums = flow.running("a", "0", lambda s, x: f"{s} + {x}", lambda s, x: f"{s} * 10 + {x} % 10", "int")
    after = flow.states("a", "0", lambda s, x: f"{s} + {x}", "int")
    for row in df.select("n", F.expr(sums).alias("before"), F.expr(after).alias("after")).collect():
        total, before, states = 0, [], []
        for x in range(row.n):
            before.append(total * 10 + x % 10)
            total += x
            states.append(total)
        assert row.before == before and row.after == states


def test_text_is_shown_as_it_stands(spark):
    source = java('\u0001 String t; st.execute("select \u0002" + x);') + "\n\u0001last"
    files = spark.createDataFrame([("a.java", source)], "file_path string, content string")
    row = [r for r in flow.flow_violations(files).collect() if "execute/query" in r.description][0]
    assert row.context_after == ["\u0001last"] and "" in row.line_content


def test_no_exchange_of_files(spark, tmp_path):
    spark.createDataFrame([("a.java", java("x();"))], "file_path string, content string").write.parquet(f"{tmp_path}/f")
    files = spark.read.parquet(f"{tmp_path}/f")
    for df in (flow.flow_hits(files), flow.flow_violations(files), flow.placed_statements(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1
    whole = scan.scan(files)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange") == 1  # of findings, for the deduplication


def test_emit_order_holds_in_long_files(spark):
    source = "class A { void f() {\n" + "\n" * 1_200_000 + 'String s = "select * from t"; st.execute("select " + x); } }'
    rows = flow.flow_violations(spark.createDataFrame([("a.java", source)], "file_path string, content string")).collect()
    order = {r.violation_type: r.emit_ord for r in rows}
    assert order["STRING_CONCAT_SQL"] < order["SELECT_STAR"]


def test_unclosed_blocks_end_with_the_file(spark):
    files = spark.createDataFrame([("a.java", "class A { void f() { for (;;) { x();\ny();"), ("b.py", "def f():\n  x = 1\n  y = 2")],
                                  "file_path string, content string")
    ends = {(r.file_path, r.header): r.last_no for r in flow.scope_blocks(files).collect()}
    assert ends[("b.py", "def f():")] == 2 and ends[("a.java", "void f() {")] == max(
        r.no for r in flow.statements(files).where("file_path = 'a.java'").collect())
