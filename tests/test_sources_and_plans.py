import json
import os

from pyspark.sql import functions as F

from lintlake.operators import scan
from lintlake.plans.corpus import corpus_files, table
from lintlake.session import scratch_dir
from lintlake.sources import files as src
from lintlake.sources import results
from lintlake.streaming import scan_stream as streaming


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def make_tree(root):
    entries = {
        "pkg/__init__.py": b"x = 1", ".hid/b.py": b"b", "_priv/c.py": b"c", "build/d.py": b"d", "Build/E.PY": b"e",
        "a/venv/x.py": b"v", "a/b/venv.py": b"w", "crlf.sql": b"SELECT *\r\nFROM t\r", "latin.java": "é".encode("latin-1"),
        "big.sql": b"x" * 2049, "edge.sql": b"y" * 2048, "note.txt": b"n", "Makefile": b"m", "deep/1/2/3/4.cs": b"f",
    }
    for name, data in entries.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as handle:
            handle.write(data)
    os.symlink(f"{root}/deep", f"{root}/loop")
    os.symlink(f"{root}/missing.py", f"{root}/broken.py")
    return entries


def test_discovery_keeps_hidden_names_and_skips_by_exact_name(spark, tmp_path):
    make_tree(str(tmp_path))
    found = src.discover_files(spark, str(tmp_path), max_kb=2).collect()
    assert [r.relative_path for r in found] == sorted([
        "pkg/__init__.py", ".hid/b.py", "_priv/c.py", "Build/E.PY", "a/b/venv.py", "crlf.sql", "latin.java",
        "edge.sql", "deep/1/2/3/4.cs"])
    assert {r.relative_path: r.route_language for r in found}["Build/E.PY"] == "PYTHON"
    only = src.discover_files(spark, str(tmp_path), only=["crlf.sql", "nope.py"]).collect()
    assert [r.relative_path for r in only] == ["crlf.sql"]


def test_reading_decodes_and_tolerates_lost_files(spark, tmp_path):
    make_tree(str(tmp_path))
    found = src.discover_files(spark, str(tmp_path), max_kb=2)
    os.remove(f"{tmp_path}/_priv/c.py")
    text = {r.relative_path: r.content for r in src.read_files(found).collect()}
    assert text["crlf.sql"] == "SELECT *\nFROM t\n" and text["latin.java"] == "é" and text["_priv/c.py"] == ""
    seen = src.read_visible(spark, str(tmp_path), max_kb=2).collect()
    assert {os.path.basename(r.file_path) for r in seen} == {"E.PY", "venv.py", "crlf.sql", "latin.java", "edge.sql", "4.cs"}


def test_write_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a/x.py", "é\n"), ("b/_y.sql", "")], "file_path string, content string")
    assert src.write_files(df, str(tmp_path)) == 2
    assert open(f"{tmp_path}/a/x.py", encoding="utf-8").read() == "é\n" and os.path.exists(f"{tmp_path}/b/_y.sql")


def test_scan_documents_split_large_repositories_without_loss(spark, sf):
    files = corpus_files(spark, sf).cache()
    v = scan.scan_lines(files).withColumn("repo", F.substring_index("file_path", "/", 2)).cache()
    whole = results.scan_documents(files, v)
    assert whole.count() == files.select("repo").distinct().count()
    split = results.scan_documents(files, v, max_rows=10)
    assert split.count() > whole.count()
    for docs in (whole, split):
        rows = results.violations_of(docs)
        assert rows.count() == v.count() == rows.select("file_path", "line_number", "violation_type").distinct().count()
    doc = json.loads(results.indented_json(whole).first().text)
    assert set(doc) >= {"repo_path", "violations", "stats"}
    assert sum(doc["stats"]["violations_by_type"].values()) == doc["stats"]["total_violations"] == len(doc["violations"])


def test_stream_equals_batch(spark, sf):
    base = scratch_dir(spark, "test-stream")
    files = corpus_files(spark, sf).select("file_path", "content")
    files.repartition(3).write.parquet(f"{base}/in")
    stream = streaming.table_stream(spark, f"{base}/in", files.schema, 1)
    streaming.scan_stream(stream, f"{base}/out", f"{base}/cp").awaitTermination()
    columns = ["file_path", "line_number", "violation_type", "confidence_score", "description"]
    got = spark.read.parquet(f"{base}/out").select(*columns)
    want = scan.scan(files).select(*columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_file_stream_scans_new_files(spark, tmp_path):
    make_tree(f"{tmp_path}/in")
    stream = streaming.file_stream(spark, f"{tmp_path}/in", max_kb=2)
    streaming.scan_lines_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(os.path.basename(r.file_path), r.line_number) for r in rows] == [("crlf.sql", 1)]


def test_line_scan_has_no_exchange(spark, tmp_path):
    spark.createDataFrame([("a.py", "x")], "file_path string, content string").write.parquet(f"{tmp_path}/f")
    files = spark.read.parquet(f"{tmp_path}/f")
    plan = plan_of(scan.scan_lines(files))
    assert "Exchange" not in plan and "Python" not in plan


def test_flow_has_no_exchange(spark, tmp_path):
    from lintlake.operators.flow import flow_hits

    spark.createDataFrame([("a.py", "x")], "file_path string, content string").write.parquet(f"{tmp_path}/f")
    plan = plan_of(flow_hits(spark.read.parquet(f"{tmp_path}/f")))
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_statistics_prune_columns(spark, sf):
    from lintlake.functions.text import code_hash

    plan = plan_of(table(spark, sf, "documents").select("doc_id", code_hash(F.col("text"))))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_no_query_uses_cross_joins_or_row_udfs(spark, sf):
    from lintlake.plans.queries import QUERIES

    writes = {"src_discover_files", "src_read_decode", "src_read_scan_json", "src_read_manifest", "sink_scan_json",
              "scan_stream", "manifest_summary_check", "manifest_match"}
    for name in sorted(set(QUERIES) - writes):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
