"""Texts of bounded size, globs as a table, counts that merge, streams with repeated deliveries."""

import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import folding, replies, review, scan
from lintlake.session import scratch_dir
from lintlake.streaming import scan_stream as streaming


@pytest.mark.parametrize("max_bytes", [16, 200, 10_000])
def test_folded_texts_lose_nothing(spark, max_bytes):
    rng = random.Random(max_bytes)
    # one group holds most pieces, one is null, one has a piece far above the bound, some are empty
    rows = [("hot", i, rng.choice(["", "é", "x" * rng.randint(1, 30), "日本 𝒳 "])) for i in range(600)]
    rows += [(None, 1, "null"), (None, 2, "-key"), ("long", 1, "ä" * 5000), ("long", 2, "end"), ("empty", 1, None)]
    want = {}
    for k, _, t in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[k] = want.get(k, "") + (t or "")
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, t string").repartition(5)
    got = {}
    for r in folding.fold_texts(df, "k", order=F.col("n"), text=F.col("t"), max_bytes=max_bytes).collect():
        assert len(r.text.encode()) <= max_bytes
        got.setdefault(r.k, {})[r.part] = (r.text, r.parts)
    assert set(got) == set(want)
    for k, parts in got.items():
        assert sorted(parts) == list(range(1, len(parts) + 1)) and {p for _, p in parts.values()} == {len(parts)}
        assert "".join(parts[i][0] for i in sorted(parts)) == want[k]
        assert (len(parts) == 1) == (len(want[k].encode()) <= max_bytes)
    with pytest.raises(ValueError):
        folding.fold_texts(df, order=F.col("n"), text=F.col("t"))


def test_long_bodies_and_prompts_come_in_parts(spark):
    fixes = spark.range(500).select(
        F.concat(F.lit("src/f"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("file_path"),
        F.lit(7).alias("line_number"), F.lit("SELECT_STAR").alias("violation_type"), F.lit(0.9).alias("fix_confidence"),
        F.lit(1).alias("detector_ord"), F.lit(7).alias("emit_ord"), F.lit("why").alias("explanation"), F.lit("r").alias("repo"))
    parts = review.pr_body(fixes, "repo", max_bytes=4096).orderBy("part").collect()
    assert len(parts) > 3 and all(len(r.body.encode()) <= 4096 and r.parts == len(parts) for r in parts)
    text = "".join(r.body for r in parts)
    assert text == review.pr_body(fixes, "repo").first().body
    assert text.count("| SELECT_STAR | 90% |") == 500 and text.index("src/f0001") < text.index("src/f0499")
    prompts = replies.prompt_pr_description(fixes, "repo", max_bytes=4096).orderBy("part").collect()
    assert len(prompts) > 3 and sum(p.prompt.count("- SELECT_STAR src/f") for p in prompts) == 500
    assert all("500" in p.prompt for p in prompts)


GLOBS = ["src/*.py", "*.py", "src/a?.sql", "*/[!x]b.cs", "lib/*/main.java", "lib/*", "*mid*", "src/a1.sql", "[ab].txt", "*.s[q]l", "x]y*", ""]


@pytest.mark.parametrize("seed", range(4))
def test_globs_in_a_table_equal_the_case(spark, seed):
    rng = random.Random(seed)
    rules = [(g, f"who{i}") for i, g in enumerate(rng.sample(GLOBS, rng.randint(0, len(GLOBS))))]
    paths = ["src/a1.sql", "src/ab.sql", "src/x/y.py", "a.txt", "c.txt", "lib/q/main.java", "lib/z", "k/ab.cs", "k/xb.cs",
             "k/midway", "x]yz", "", "a.py", "src/a1.sql", "ü/ü.py"]
    files = spark.createDataFrame([(p,) for p in paths], "file_path string")
    want = {r.file_path: r.w for r in files.select("file_path", review.reviewer_for_path(rules).alias("w")).collect()}
    got = review.reviewers_by_table(files, review.reviewer_rules(spark, rules)).collect()
    assert len(got) == len(want) and {r.file_path: r.reviewer for r in got} == want


def test_large_glob_tables_are_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(review, "MAX_BROADCAST_RULES", 1)
    rules = [("src/*", "a"), ("*.py", "b"), ("*", "c")]
    files = spark.createDataFrame([("src/x.py",), ("y.py",), ("z",)], "file_path string")
    got = review.reviewers_by_table(files, review.reviewer_rules(spark, rules)).collect()
    assert {r.file_path: r.reviewer for r in got} == {"src/x.py": "a", "y.py": "b", "z": "c"}


def found(spark, rows):
    return spark.createDataFrame(rows, "repo string, violation_type string, severity string, platform string, language string")


def test_counts_of_batches_merge_to_a_recount(spark):
    rng = random.Random(2)
    rows = [tuple(rng.choice(v) for v in (["r1", "r2", None], ["A", "B"], ["HIGH"], ["p", None], ["Java", "C#"])) for _ in range(90)]
    table = scan.CountTable(spark, scratch_dir(spark, "counts"), "repo")
    for n in range(3):
        table.add(f"b{n}", found(spark, rows[n * 30:n * 30 + 30]))
    table.add("b1", found(spark, rows[30:60]))  # a batch that ran twice
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(table.counts()) == key(scan.counts_by(found(spark, rows), "repo"))
    counts = {(r.level, r.repo, r.facet, r.value): r.n for r in table.counts().collect()}
    assert counts["all", None, "total", None] == 90
    assert counts["group", None, "total", None] == sum(r[0] is None for r in rows)
    assert counts["group", "r1", "platform", None] == sum(r[0] == "r1" and r[3] is None for r in rows)
    assert counts["all", None, "violation_type", "A"] == sum(r[1] == "A" for r in rows)
    flat = {(r.facet, r.value): r.n for r in scan.counts_by(found(spark, rows)).collect()}
    assert flat["total", None] == 90 and flat["language", "Java"] == sum(r[4] == "Java" for r in rows)
    plan = scan.counts_by(found(spark, rows), "repo")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Expand") == 1


def test_repeated_deliveries_are_scanned_once(spark):
    base = scratch_dir(spark, "stream")
    one = [("a/x.sql", "SELECT * FROM t\n"), ("a/clean.py", "x = 1\n"), ("a/n.sql", None)]
    two = one + [("a/x.sql", "SELECT 1\n"), ("b/y.sql", "SELECT * FROM u\nSELECT * FROM v\n")]
    for rows in (one, one + one):
        spark.createDataFrame(rows, "file_path string, content string").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        files = streaming.table_stream(spark, f"{base}/in", "file_path string, content string", 1)
        streaming.scan_gate_stream(files, f"{base}/out", f"{base}/cp").awaitTermination()
        return [sorted(tuple(r) for r in spark.read.parquet(f"{base}/out/{t}").select(*c).collect()) for t, c in (
            ("violations", ("file_path", "line_number")), ("gate", ("file_path", "violations", "approval_required")))]

    violations, gate = run()
    assert violations == [("a/x.sql", 1)]
    assert gate == [("a/clean.py", 0, False), ("a/n.sql", 0, False), ("a/x.sql", 1, True)]
    spark.createDataFrame(two, "file_path string, content string").write.mode("append").parquet(f"{base}/in")
    violations, gate = run()  # goes on from its checkpoint
    assert violations == [("a/x.sql", 1), ("b/y.sql", 1), ("b/y.sql", 2)]
    assert [g for g in gate if g[0] == "a/x.sql"] == [("a/x.sql", 0, False), ("a/x.sql", 1, True)]
