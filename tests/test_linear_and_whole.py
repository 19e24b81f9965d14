"""Large and odd inputs: linear time, nothing lost without a message."""

import os
import time

import pytest

from lintlake.functions import secrets, text
from lintlake.operators import flow, manifest, replies, scan
from lintlake.sources import files as src
from pyspark.sql import functions as F


@pytest.mark.parametrize("name, content", [
    ("a.java", 'class A { void f(){ String s = "select ' + "x" * 500_000 + '"; st.executeQuery(s); } }'),
    ("b.py", "q = 1\n# select " + "y" * 500_000 + "\ncursor.execute(q)\n"),
    ("c.cs", 'class A { void F(){ var s = "select " + x; new SqlCommand(' + "z" * 500_000 + "); } }"),
    ("d.java", "int a; " + " " * 500_000 + "int b;"),
])
def test_large_files_take_seconds(spark, corpus, name, content):
    df = corpus({name: content})
    for work in (flow.statements, flow.flow_hits, scan.scan_lines):
        begin = time.time()
        work(df).count()
        assert time.time() - begin < 30


def test_strip_takes_every_blank(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    assert sorted(text.BLANKS) == sorted(blanks)
    rows = [(b + "x y" + b,) for b in blanks] + [("\x1cx y",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(text.strip(F.col("t")), F.expr(text.strip_sql("t"))).collect()]
    assert got == [("x y",) * 2] * len(blanks) + [("\x1cx y",) * 2, ("",) * 2]


def test_prefix_of_a_longer_identifier_is_still_found(spark, corpus):
    df = corpus({"a.cs": 'class A { void F() { var sql = "SELECT a FROM t WHERE i=" + id; new SqlCommand(sqlText); } }'})
    assert "cs_sql_var" in {r.check for r in flow.flow_hits(df).collect()}


def test_base_relations_keep_files_without_rule_words(spark, corpus):
    df = corpus({"a.java": "int x = 1; // c\n"})
    assert flow.code_mask(df).count() == 1 and flow.statements(df).count() == 1 and flow.flow_hits(df).count() == 0
    long = corpus({"a.java": "class A { void " + "f" * 300 + "() { int x; } }"})
    assert max(len(r.header) for r in flow.scope_blocks(long).collect()) > 300


def test_skipped_files_are_told(spark, tmp_path):
    for name, size in (("a.py", 10), ("b.py", 4000), ("c.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [r.relative_path for r in src.discover_files(spark, str(tmp_path)).collect()] == ["a.py", "b.py"]
    told = {r.relative_path: r.skipped for r in src.skipped_files(spark, str(tmp_path), max_kb=2).collect()}
    assert told == {"b.py": "too large", "c.txt": "no known suffix"}


def test_only_missing_files_read_as_empty(tmp_path):
    assert src._read_one(str(tmp_path / "gone.py")) is None
    os.makedirs(tmp_path / "folder.py")
    with pytest.raises(OSError):
        src._read_one(str(tmp_path / "folder.py"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(OSError):
        list(src._entries(str(tmp_path / "file")))


def test_maps_of_any_value_are_masked(spark):
    df = spark.sql("select map('a', map('password', 'hunter2', 'k', 'v')) m, map('pwd', 1234, 'n', 5) n, "
                   "map('secret', map('x', 1)) s, map(1, map('token', 't')) i")
    row = secrets.mask_fields(df).first().asDict()
    assert row == {"m": {"a": {"password": "***REDACTED***", "k": "v"}}, "n": {"pwd": None, "n": 5},
                   "s": {"secret": None}, "i": {1: {"token": "***REDACTED***"}}}


def test_replies_of_other_kinds_and_retries_do_not_multiply(spark):
    df = spark.createDataFrame([
        ("v", "fix", '{"fixed_code": "b"}', None), ("v", "fix", None, "timeout"), ("v", "fix", '{"fixed_code": "a"}', ""),
        ("v", "review", "{}", None), ("w", "fix", None, "timeout")], "violation_id string, kind string, content string, error string")
    got = {r.violation_id: r.content for r in replies.one_reply(df, "fix").collect()}
    assert got == {"v": '{"fixed_code": "a"}', "w": None}


def test_ids_of_one_manifest_do_not_mark_another(spark):
    item = ("V1", "f", "SELECT_STAR", "d", "SQL", "5-5", "c", "LOW", "b")
    rows = [("one", [item], {"SELECT_STAR": 2}), ("two", [("V1", "g", *item[2:])], {"SELECT_STAR": 0})]
    docs = spark.createDataFrame(rows, f"manifest string, violations array<{manifest_item()}>, violation_type_summary map<string,bigint>").withColumns(
        {c: F.lit(None).cast("map<string,bigint>") for c in ("severity_summary", "platform_summary")})
    check = {(r.manifest, r.value): r.difference for r in manifest.summary_check(docs).where("facet = 'violation_type'").collect()}
    assert check == {("one", "SELECT_STAR"): 1, ("two", "SELECT_STAR"): -1}
    found = spark.createDataFrame([("f", 5, list(manifest.TYPE_OF_WORD.values())[list(manifest.TYPE_OF_WORD).index("SELECT_STAR")])],
                                  "file_path string, line_number int, violation_type string")
    assert {r.manifest: r.matched for r in manifest.match(manifest.items(docs), found).collect()} == {"one": True, "two": False}


def manifest_item():
    from lintlake.schema import MANIFEST_ITEM
    return MANIFEST_ITEM


def test_split_documents_hold_their_statistics_once(spark, sf):
    from lintlake.plans.corpus import corpus_files
    from lintlake.sources import results
    files = corpus_files(spark, sf)
    v = scan.scan_lines(files).withColumn("repo", F.substring_index("file_path", "/", 2))
    whole, split = (results.scan_documents(files, v, max_rows=n) for n in (None, 2))
    total = F.sum("stats.total_violations")
    assert whole.agg(total).first() == split.agg(total).first()
    assert split.where("doc_no > 0").where("stats is null").count() == split.where("doc_no > 0").count() > 0


def nested(call, inner, depth):
    return call + "(" + "".join(f"f{i}(" for i in range(depth)) + inner + ")" * depth + ")"


@pytest.mark.parametrize("depth", [1, 4, 5, 20])
def test_brackets_of_any_depth(spark, corpus, depth):
    sources = {
        "a.java": ("class A { void f(){ " + nested("x.executeQuery", '"SELECT a FROM t WHERE i=" + v', depth) + "; } }", "java_concat_call"),
        "b.py": ("c = " + nested("psycopg2.connect", "1", depth) + "\n", "py_connect"),
        "c.py": ("c = " + nested("MongoClient", "1", depth) + "\n", "py_mongo"),
        "d.py": ('cur.execute(f"SELECT a FROM t WHERE i={i}", ' + nested("g", "1", depth) + ")\n", "py_fstring"),
        "e.cs": ("class A { void F() { var c = " + nested("new SqlCommand", "q", depth) + "; } }", "cs_cmd_timeout"),
    }
    got = flow.flow_hits(corpus({n: t for n, (t, _) in sources.items()})).collect()
    assert {(r.file_path, r.check) for r in got} == {(n, c) for n, (_, c) in sources.items()}
    assert not any(mark in r.quoted for r in got for mark in (flow.CUT, flow.MARK))


def test_whole_files_are_decoded_by_a_registered_query(spark, sf, monkeypatch):
    import hashlib

    from lintlake.plans import queries

    texts = {f"repo/src/f{n}.py": "x = 1\n" * 500 + "#" * n for n in range(3)}  # one of each encoding
    files = spark.createDataFrame(list(texts.items()), "file_path string, content string")
    monkeypatch.setattr(queries, "_CODE", lambda spark, sf: files)
    got = {r.relative_path: (r.n_chars, r.hash) for r in queries.QUERIES["src_read_decode_whole"](spark, sf).collect()}
    want = {p: t if len(t) % 3 == 2 else t + "é" for p, t in texts.items()}
    assert got == {p: (len(t), hashlib.sha256(t.encode()).hexdigest()) for p, t in want.items()}


def test_ranges_of_any_length_and_paths_of_either_kind(spark):
    import random

    rng = random.Random(7)
    words = list(manifest.TYPE_OF_WORD)
    rows = [("m", f"v{i}", rng.choice(["/r/a.py", "b.py", "/r/c/d.py"]), rng.choice(words), rng.randint(1, 60), rng.randint(1, 60))
            for i in range(300)]
    rows += [("m", "all", "/r/a.py", words[0], 1, 5_000_000), ("m", "none", "b.py", words[0], None, None),
             ("m", "word", "b.py", "OTHER", 1, 9), ("n", "v0", "x.py", words[0], 1, 2)]
    expected = spark.createDataFrame(rows, "manifest string, violation_id string, file string, violation_type string, lo int, hi int")
    found = [(rng.choice(["a.py", "/r/b.py", "c/d.py"]), rng.randint(1, 60), rng.choice(list(manifest.TYPE_OF_WORD.values())))
             for _ in range(40)]
    got = manifest.match(expected, spark.createDataFrame(found, "file_path string, line_number int, violation_type string"), "/r")
    path = lambda p: p.removeprefix("/r/")
    want = {(m, v): any(path(f) == path(file) and t == manifest.TYPE_OF_WORD.get(word) and lo is not None
                        and min(lo, hi) <= n <= max(lo, hi) for f, n, t in found) for m, v, file, word, lo, hi in rows}
    assert {(r.manifest, r.violation_id): r.matched for r in got.collect()} == want
    assert "Generate explode(sequence" not in got._jdf.queryExecution().executedPlan().toString()
