"""The query registry: every operator over tables, as (spark, sf_dir) -> DataFrame.

Queries on code run on the corpus derived from ``events``; text queries run on
``documents``, ``pages`` and ``events`` themselves.  All read their tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import LONG_RUNNING_TXN, MAX_FILE_SIZE_KB, READ_PREFERENCE, SELECT_STAR, STRING_CONCAT_SQL, UNBATCHED_TXN
from ..functions import secrets
from ..functions.lang import platform, route_language, rule_language, concat_language, severity, is_mongo_file
from ..functions.text import code_hash, parse_repo_url, base_name, relative_path, violation_id
from ..operators import fixes as fx
from ..operators import flow, lines, manifest, replies, review, rules, scan, secondary
from ..session import scratch_dir, stored
from ..sources import files as src
from ..sources import results
from ..streaming import scan_stream as streaming
from .corpus import corpus_files, corpus_lines, table

QUERIES: dict = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


# --- shared inputs -------------------------------------------------------------

_CODE = corpus_files


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan_lines(_CODE(spark, sf))


def _with_repo(df: DataFrame) -> DataFrame:
    """The corpus keeps the repository in the first two path parts."""
    return df.withColumn("repo", F.substring_index("file_path", "/", 2))


def _flat(df: DataFrame) -> DataFrame:
    """Violations with the contexts as text, so that they compare as scalars."""
    return df.select(
        "file_path", "line_number", "line_content", "violation_type", "severity", "platform",
        "language", "description", "confidence_score",
        F.array_join("context_before", "\n").alias("ctx_before"),
        F.array_join("context_after", "\n").alias("ctx_after"))


# --- sources and sinks -----------------------------------------------------------


def _placed_path(path: str = "file_path") -> str:
    """Spreads corpus files over visible, hidden, underscored and skipped folders and names."""
    n = f"cast(regexp_extract({path}, 'f([0-9]+)[.]', 1) as int)"
    return (
        f"CASE {n} % 7 WHEN 1 THEN concat('build/', {path}) WHEN 2 THEN concat('_priv/', {path}) "
        f"WHEN 3 THEN concat('.hid/', {path}) WHEN 4 THEN concat('Build/', {path}, '.PY') "
        f"WHEN 5 THEN concat({path}, '.txt') "
        f"WHEN 6 THEN concat('pkg/', replace({path}, '/src/f', '/src/__f')) ELSE {path} END")


@query("src_discover_files")
def _discover(spark, sf):
    root = scratch_dir(spark, "tree")
    src.write_files(_CODE(spark, sf).withColumn("file_path", F.expr(_placed_path())), root)
    return src.discover_files(spark, root, MAX_FILE_SIZE_KB, ordered=False).select(
        "relative_path", "route_language", "size_bytes")


_NAMES = "array('.py', '.PY', '.Cs', '.java', '.sql.bak', '', '.XML', '.sql', '/.py', '.')"


@query("src_file_language")
def _file_language(spark, sf):
    name = F.expr(f"concat('d', doc_id, element_at({_NAMES}, cast(doc_id % 10 as int) + 1))")
    return table(spark, sf, "documents").select("doc_id", name.alias("path")).select(
        "doc_id", "path", route_language("path").alias("language"))


def _decoded(spark, sf, truncate_kb=None):
    """Some files as UTF-8, some as Latin-1, some with other line ends, written and read."""
    root = scratch_dir(spark, "bytes")
    kind = "line_count % 3"
    data = F.expr(
        f"CASE {kind} WHEN 0 THEN encode(concat(content, 'é'), 'UTF-8') "
        f"WHEN 1 THEN encode(concat(content, 'é'), 'ISO-8859-1') "
        f"ELSE encode(replace(content, '\\n', '\\r\\n'), 'UTF-8') END")
    files = _CODE(spark, sf).withColumn("line_count", F.length("content")).withColumn("data", data)
    src.write_files(files, root, content="data")
    found = src.discover_files(spark, root, ordered=False)
    read = src.read_files(found, truncate_kb=truncate_kb)
    return read.select("relative_path", F.length("content").cast("bigint").alias("n_chars"),
                       code_hash(F.col("content")).alias("hash"))


@query("src_read_decode")
def _read_decode(spark, sf):
    """Cut at one kilobyte."""
    return _decoded(spark, sf, truncate_kb=1)


@query("src_read_decode_whole")
def _read_decode_whole(spark, sf):
    return _decoded(spark, sf)


def _documents(spark, sf):
    files, violations = _CODE(spark, sf), _with_repo(_violations(spark, sf))
    return results.scan_documents(files, violations)


@query("sink_scan_json")
def _sink_scan_json(spark, sf):
    path = scratch_dir(spark, "scan-json")
    results.write_scan_json(_documents(spark, sf), path)
    back = results.read_scan_json(spark, path, multi_line=False)
    types = F.array_join(F.transform(F.array_sort(F.map_entries("stats.violations_by_type")),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return back.groupBy("repo_path").agg(
        F.max("stats.total_files_scanned").alias("files"),
        F.max("stats.total_violations").alias("violations"),
        F.sum(F.size("violations")).alias("listed"), F.max(types).alias("by_type"))


@query("src_read_scan_json")
def _read_scan_json(spark, sf):
    """Indented documents, one file per repository, written and read back."""
    root = scratch_dir(spark, "scan-docs")
    docs = results.indented_json(_documents(spark, sf)).select(
        F.concat("repo_path", F.lit("/scan-"), F.col("doc_no").cast("string"), F.lit(".json"))
        .alias("file_path"), F.col("text").alias("content"))
    src.write_files(docs, root)
    rows = results.violations_of(results.read_scan_json(spark, root))
    return rows.select(
        "repo_path", "file_path", "line_number", "line_content", "violation_type", "severity",
        "platform", "language", "confidence_score",
        F.array_join("context_before", "\n").alias("ctx_before"))


@query("sink_violation_rows")
def _sink_rows(spark, sf):
    return scan.export_rows(_violations(spark, sf), root="repos")


@query("scan_stream")
def _scan_stream(spark, sf):
    base = scratch_dir(spark, "stream")
    files = _CODE(spark, sf).select("file_path", "content")
    files.write.parquet(f"{base}/in")
    stream = streaming.table_stream(spark, f"{base}/in", files.schema, max_files_per_trigger=2)
    streaming.scan_lines_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return _flat(spark.read.parquet(f"{base}/out"))


def _full_stream(spark, sf):
    """The whole corpus, every file delivered twice, through the full scan with its gate."""
    base = scratch_dir(spark, "stream")
    files = _CODE(spark, sf).select("file_path", "content")
    for _ in range(2):
        files.write.mode("append").parquet(f"{base}/in")
    stream = streaming.table_stream(spark, f"{base}/in", files.schema)
    streaming.scan_gate_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out"


@query("scan_stream_full")
def _scan_stream_full(spark, sf):
    return spark.read.parquet(f"{_full_stream(spark, sf)}/violations").select(
        "file_path", "line_number", "violation_type", "severity", "language", "confidence_score", "detector_ord")


@query("scan_stream_gate")
def _scan_stream_gate(spark, sf):
    return spark.read.parquet(f"{_full_stream(spark, sf)}/gate").select("file_path", "violations", "approval_required")


# --- projections -----------------------------------------------------------------


@query("explode_lines")
def _explode(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return lines.explode_lines(docs)


@query("line_context")
def _line_context(spark, sf):
    return lines.line_context(_CODE(spark, sf)).select(
        "file_path", "line_number", "line", F.array_join("context_before", "\n").alias("ctx_before"),
        F.array_join("context_after", "\n").alias("ctx_after"))


@query("line_windows")
def _line_windows(spark, sf):
    return lines.line_windows(_CODE(spark, sf))


@query("rule_language")
def _rule_language(spark, sf):
    return _CODE(spark, sf).select(
        "file_path", route_language().alias("route_language"),
        rule_language().alias("rule_language"), concat_language().alias("concat_language"))


@query("platform_infer")
def _platform(spark, sf):
    return _CODE(spark, sf).select(
        "file_path", platform().alias("base"), platform(variant="select").alias("select_star"),
        platform(variant="longtxn").alias("long_txn"))


@query("severity_map")
def _severity(spark, sf):
    kinds = ", ".join(f"'{t}'" for t in (
        SELECT_STAR, STRING_CONCAT_SQL, UNBATCHED_TXN, LONG_RUNNING_TXN, READ_PREFERENCE, "OTHER"))
    return table(spark, sf, "events").select("event_id", F.expr(
        f"element_at(array({kinds}), cast(event_id % 6 as int) + 1)").alias("violation_type")
    ).withColumn("severity", severity())


@query("violation_validate")
def _validate(spark, sf):
    rows = corpus_lines(spark, sf).select(
        "file_path", F.expr("line_number - 1").alias("line_number"), F.col("line").alias("line_content"),
        F.expr("if(line_number % 9 = 0, '  ', 'text')").alias("description"),
        F.expr("line_number / 38D").alias("confidence_score"))
    return scan.validate(rows)


@query("code_hash")
def _code_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", code_hash(F.col("text")).alias("hash"))


@query("violation_id")
def _violation_id(spark, sf):
    return _violations(spark, sf).select("file_path", "line_number", "violation_type", violation_id(
        F.col("file_path"), F.col("line_number"), F.col("violation_type")).alias("violation_id"))


@query("cost_estimate")
def _cost(spark, sf):
    prompts = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("prompt"), F.expr(
            "element_at(array('claude-sonnet-4-6', 'claude-opus-4-6', 'other'), cast(doc_id % 3 as int) + 1)")
        .alias("model"))
    return replies.cost_estimate(prompts, spark).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


_URL = (
    "CASE page_id % 6 WHEN 0 THEN concat('https://github.com/own', page_id, '/rep', page_id) "
    "WHEN 1 THEN concat('  https://github.com/own', page_id, '/rep.git/ ') "
    "WHEN 2 THEN concat('http://github.com/own/rep', page_id, '/tree/main/a/b', page_id) "
    "WHEN 3 THEN concat('https://github.com/own/rep', page_id, '/tree/main') "
    "WHEN 4 THEN concat('https://github.com/own', page_id) ELSE url END")


@query("parse_repo_url")
def _repo_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.expr(_URL).alias("link")).select(
        "page_id", parse_repo_url(F.col("link")).alias("p")).select("page_id", "p.owner", "p.repo", "p.folder")


@query("path_rel_base")
def _rel_base(spark, sf):
    return _CODE(spark, sf).select(
        "file_path", relative_path(F.col("file_path"), F.col("repo")).alias("relative_path"),
        base_name(F.col("file_path")).alias("file_name"))


# --- line rules --------------------------------------------------------------------


def _rule_query(name: str):
    rule = next(r for r in rules.RULES if r.name == name)
    return lambda spark, sf: _flat(scan.scan_lines(_CODE(spark, sf), rules=(rule,), loop_rules=()))


for _r in rules.RULES:
    QUERIES[f"det_{_r.name}"] = _rule_query(_r.name)


def _loop_query(name: str):
    rule = next(r for r in rules.LOOP_RULES if r.name == name)
    return lambda spark, sf: scan.loop_matches(_CODE(spark, sf), (rule,))


for _r in rules.LOOP_RULES:
    QUERIES[f"det_{_r.name}"] = _loop_query(_r.name)


@query("det_unbatched_bucket")
def _bucket(spark, sf):
    return _flat(scan.scan_lines(_CODE(spark, sf), rules=()))


@query("det_readpref_filegate")
def _filegate(spark, sf):
    return _CODE(spark, sf).select("file_path", is_mongo_file().alias("is_mongo"))


for _key, _language in (("aux_csharp", "C#"), ("aux_java", "JAVA"), ("aux_python", "PYTHON"),
                        ("aux_sql", "SQL")):
    QUERIES[_key] = (lambda language: lambda spark, sf: secondary.secondary_hits(
        _CODE(spark, sf), language))(_language)


# --- statements, scopes, flow --------------------------------------------------------


@query("code_mask")
def _mask(spark, sf):
    return flow.code_mask(_CODE(spark, sf))


@query("stmt_stitch")
def _stitch(spark, sf):
    return flow.statements(_CODE(spark, sf)).select("file_path", "no", "line", "text", "term")


@query("scope_blocks")
def _scopes(spark, sf):
    return flow.scope_blocks(_CODE(spark, sf))


@query("loop_blocks")
def _loops(spark, sf):
    return flow.loop_blocks(_CODE(spark, sf))


FLOW_QUERIES = {
    "flow_java_sql_var": ("java_sql_var",), "flow_java_concat_call": ("java_concat_call",),
    "flow_java_loop": ("java_loop",),
    "flow_java_transactional": ("java_transactional", "java_transactional_args"),
    "flow_java_stmt_prepared": ("java_stmt_prepared",), "flow_java_select_star": ("java_select_star",),
    "flow_py_sql_var": ("py_sql_var",), "flow_py_fstring": ("py_fstring",), "flow_py_loop": ("py_loop",),
    "flow_py_mongo": ("py_mongo",), "flow_py_connect": ("py_connect",),
    "flow_py_select_star": ("py_select_star",), "flow_cs_sql_var": ("cs_sql_var",),
    "flow_cs_interpolated": ("cs_interpolated",), "flow_cs_loop": ("cs_loop",),
    "flow_cs_txnscope": ("cs_txnscope",), "flow_cs_cmd_timeout": ("cs_cmd_timeout",),
    "flow_cs_select_star": ("cs_select_star",),
}


def _flow_query(checks: tuple[str, ...]):
    return lambda spark, sf: flow.flow_hits(_CODE(spark, sf), checks).select(
        "file_path", "line_number", "violation_type", "confidence_score")


for _key, _checks in FLOW_QUERIES.items():
    QUERIES[_key] = _flow_query(_checks)


@query("flow_emit")
def _flow_emit(spark, sf):
    return _flat(flow.flow_violations(_CODE(spark, sf))).select(
        "file_path", "line_number", "violation_type", "severity", "platform", "language",
        "confidence_score", F.col("description").startswith("[AST] ").alias("is_marked"),
        "ctx_before", "ctx_after")


# --- scan, dedup, statistics -----------------------------------------------------------


@query("scan_repository")
def _scan(spark, sf):
    return _flat(scan.scan(_CODE(spark, sf), flow=False))


@query("scan_repository_flow")
def _scan_flow(spark, sf):
    return scan.scan(_CODE(spark, sf)).select(
        "file_path", "line_number", "violation_type", "severity", "language", "confidence_score", "detector_ord")


@query("scan_dedup")
def _dedup(spark, sf):
    """Line rules first, the secondary pack as a later detector; the first hit per key stays."""
    files = _CODE(spark, sf)
    columns = ["file_path", "line_number", "violation_type", "detector_ord", "emit_ord"]
    first = scan.scan_lines(files).select(*columns)
    later = secondary.secondary_hits(files).withColumn("detector_ord", F.lit(9)).select(*columns)
    return scan.dedup(first.unionByName(later)).select(*columns)


@query("scan_language_route")
def _routes(spark, sf):
    return scan.language_routes(_CODE(spark, sf))


for _key, _facet in (("stats_by_type", "violation_type"), ("stats_by_severity", "severity"),
                     ("stats_by_platform", "platform"), ("stats_by_language", "language")):
    QUERIES[_key] = (lambda facet: lambda spark, sf: scan.facet_counts(
        _violations(spark, sf), facet))(_facet)


@query("stats_all_facets")
def _all_facets(spark, sf):
    return scan.all_facets(_violations(spark, sf))


@query("stats_grouping_sets")
def _grouping_sets(spark, sf):
    return scan.counts_by(_with_repo(_violations(spark, sf)), "repo")


@query("stats_by_batches")
def _by_batches(spark, sf):
    """The same counts from three batches of files, each scanned and counted by itself."""
    counts = scan.CountTable(spark, scratch_dir(spark, "counts"), "repo")
    files = _CODE(spark, sf)
    for batch in range(3):
        part = files.where(F.pmod(F.xxhash64("file_path"), F.lit(3)) == batch)
        counts.add(str(batch), _with_repo(scan.scan_lines(part)))
    return counts.counts()


@query("stats_totals")
def _totals(spark, sf):
    return scan.totals(_CODE(spark, sf), _violations(spark, sf))


@query("pr_type_counts")
def _type_counts(spark, sf):
    return scan.most_common_types(_violations(spark, sf))


# --- manifests ---------------------------------------------------------------------------

# what a reviewer of the derived corpus would list: (word, substring on the line, extra lines)
_EXPECTED = (
    ("SELECT_STAR", "SELECT * FROM", 0), ("SQL_INJECTION", "${", 0),
    ("NO_TIMEOUT", "psycopg2.connect(", 1), ("NO_READ_PREFERENCE", "MongoClient(", 0),
    ("MISSING_TRY_CATCH", "executeUpdate", 2), ("UNBATCHED_INSERT", "insert_one", 3),
)


def manifest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(file_path, content): one manifest per repository, at most 320 lines of code each."""
    listed = []
    for word, text, extra in _EXPECTED:
        needle = text.replace("$", "")
        test = f"contains(line, {rules.word(text)})" if "$" not in text else \
            f"contains(line, concat('$', '{needle}'))"
        listed.append(
            f"CASE WHEN {test} THEN named_struct('violation_id', concat(file_path, '#', line_number, '#{word}'), "
            f"'file', file_path, 'violation_type', '{word}', 'database_platform', "
            f"if(line_number % 2 = 0, 'Oracle', 'MSSQL'), 'language', 'any', 'line_range', "
            f"{'concat(line_number)' if not extra else f'''concat(line_number, '-', line_number + {extra})'''}, "
            f"'code_snippet', line, 'severity', if(line_number % 3 = 0, 'MEDIUM', 'HIGH'), "
            f"'banking_context', 'context') END")
    found = (
        corpus_lines(spark, sf)
        .select("repo", F.expr(f"explode(array({', '.join(listed)}))").alias("i")).where("i is not null")
    )
    def counts(field: str):
        return (f"map_from_entries(transform(array_distinct(transform(violations, x -> x.{field})), "
                f"v -> struct(v, cast(size(filter(violations, x -> x.{field} = v)) "
                f"+ if(v IN ('SELECT_STAR', 'MSSQL'), 1, 0) as bigint))))")
    doc = (
        found.groupBy("repo").agg(F.sort_array(F.collect_list("i")).alias("violations"))
        .select("repo", F.expr(
            "to_json(named_struct('manifest_version', '1.0', 'description', repo, "
            "'total_violations', size(violations), 'violations', violations, "
            f"'violation_type_summary', {counts('violation_type')}, "
            f"'severity_summary', {counts('severity')}, "
            f"'platform_summary', {counts('database_platform')}), map('pretty', 'true'))").alias("content"))
    )
    return doc.select(F.concat("repo", F.lit("/manifest.json")).alias("file_path"), "content")


def _manifests(spark, sf):
    root = scratch_dir(spark, "manifests")
    src.write_files(manifest_documents(spark, sf), root)
    return manifest.read_manifest(spark, root)


@query("src_read_manifest")
def _read_manifest(spark, sf):
    return manifest.items(_manifests(spark, sf)).select(
        "violation_id", "file", "violation_type", "database_platform", "severity", "line_range",
        "code_snippet", "lo", "hi")


@query("manifest_summary_check")
def _summary_check(spark, sf):
    return manifest.summary_check(_manifests(spark, sf)).groupBy("facet", "value").agg(
        *[F.sum(c).alias(c) for c in ("stored", "listed", "difference")])


@query("manifest_match")
def _manifest_match(spark, sf):
    return manifest.match(manifest.items(_manifests(spark, sf)), _violations(spark, sf)).select(
        "violation_id", "mapped_type", "matched")


# --- masking and validation -----------------------------------------------------------------


def _texts(spark, sf):
    """Whole document texts and whole code files."""
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), "text")
    return docs.unionByName(_CODE(spark, sf).select(F.col("file_path").alias("id"), F.col("content").alias("text")))


@query("mask_secrets")
def _mask_secrets(spark, sf):
    return _texts(spark, sf).select("id", secrets.mask_secrets(F.col("text")).alias("masked"))


@query("mask_secrets_found")
def _mask_found(spark, sf):
    return (
        _texts(spark, sf).select("id", F.explode(secrets.secrets_found(F.col("text"))).alias("f"))
        .groupBy("id", "f.label").agg(F.count(F.lit(1)).alias("n"))
    )


@query("mask_log_text")
def _mask_log(spark, sf):
    return secrets.mask_log_columns(_texts(spark, sf))


@query("mask_fields")
def _mask_fields(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", F.col("event_type").alias("session_token"),
        F.col("props").alias("Api_Key"), F.col("event_type").alias("kind"),
        F.struct(F.col("event_type").alias("pwd_hint"), F.col("user_id").alias("uid")).alias("nested"))
    return secrets.mask_fields(rows).select(
        "event_id", "user_id", "session_token", "Api_Key", "kind",
        F.col("nested.pwd_hint").alias("nested_pwd_hint"), F.col("nested.uid").alias("nested_uid"))


@query("validate_fix")
def _validate_fix(spark, sf):
    return corpus_lines(spark, sf).select(
        "file_path", "line_number", secrets.unsafe_issues(F.col("line")).alias("i")).select(
        "file_path", "line_number", (F.size("i") == 0).alias("is_valid"), F.array_join("i", "; ").alias("issues"))


# --- fixes ---------------------------------------------------------------------------------

_FIX_COLUMNS = (
    "file_path", "line_number", "violation_type", "violation_id", "original_code", "fixed_code",
    "explanation", "ai_model_used", "fix_confidence", "security_review_passed", "security_review_notes",
)


def _fixes(spark, sf, types=None):
    return fx.template_fixes(_violations(spark, sf), types)


for _key, _types in (("fix_template", None), ("fix_select_star", (SELECT_STAR,)),
                     ("fix_string_concat", (STRING_CONCAT_SQL,)), ("fix_unbatched", (UNBATCHED_TXN,)),
                     ("fix_long_running", (LONG_RUNNING_TXN,)),
                     ("fix_read_preference", (READ_PREFERENCE,))):
    QUERIES[_key] = (lambda types: lambda spark, sf: _fixes(spark, sf, types).select(*_FIX_COLUMNS))(_types)


def _batch(spark, sf):
    return fx.template_fixes(fx.select_batch(_violations(spark, sf)))


@query("fix_select_batch")
def _select_batch(spark, sf):
    return fx.select_batch(_violations(spark, sf)).select(
        "file_path", "line_number", "violation_type", "severity", "tier")


def _model_fixes(spark, sf):
    """Fix rows as merged from the derived replies."""
    v = _violations(spark, sf)
    return replies.merge_fixes(v, derived_replies(v, "fix"))


@query("fix_ai_fallback")
def _fallback(spark, sf):
    v = stored(_violations(spark, sf), "violations")
    ai = replies.merge_fixes(v, derived_replies(v, "fix"))
    return fx.fallback(ai, fx.template_fixes(v)).select(
        "violation_id", "fixed_code", "explanation", "ai_model_used", "fix_confidence")


@query("fix_rows")
def _fix_rows(spark, sf):
    return fx.fix_rows(_fixes(spark, sf))


@query("fix_approve_web")
def _approve_web(spark, sf):
    return fx.approve_web(_model_fixes(spark, sf)).select(
        "violation_id", "approved", "notes")


@query("fix_approve_ai")
def _approve_ai(spark, sf):
    return fx.approve_reviewed(_model_fixes(spark, sf)).select("violation_id", "security_review_notes")


@query("fix_apply_first")
def _apply_first(spark, sf):
    return fx.apply_first(_CODE(spark, sf), _fixes(spark, sf))


@query("fix_apply_all")
def _apply_all(spark, sf):
    return fx.apply_all(_CODE(spark, sf), _fixes(spark, sf))


@query("fix_dry_run")
def _dry_run(spark, sf):
    return fx.dry_run_fixes(_violations(spark, sf)).select(*_FIX_COLUMNS)


# --- review ----------------------------------------------------------------------------------

PATH_RULES = [("repos/r1*/*.java", "java-team"), ("*.[sx][qm]l", "dba-team"), ("repos/r?/*", "core-team"),
              ("*/f1?.cs", "dotnet-team")]
TYPE_RULES = {STRING_CONCAT_SQL: ["sec-lead", "dba-team"], UNBATCHED_TXN: "perf-team"}


@query("reviewer_by_path")
def _by_path(spark, sf):
    return _CODE(spark, sf).select("file_path", review.reviewer_for_path(PATH_RULES).alias("reviewer"))


@query("reviewer_by_table")
def _by_table(spark, sf):
    """The same rules in a table with ten thousand other globs."""
    others = [(f"vendor/v{i}/*.java" if i % 2 else f"*/gen{i}.sql", f"team-{i % 50}") for i in range(10_000)]
    rules = review.reviewer_rules(spark, others[:5000] + PATH_RULES + others[5000:])
    return review.reviewers_by_table(_CODE(spark, sf), rules)


@query("reviewer_by_type")
def _by_type(spark, sf):
    return _violations(spark, sf).select(
        "file_path", "line_number", "violation_type",
        F.explode(review.reviewers_for_type(TYPE_RULES)).alias("reviewer"))


@query("pr_reviewers")
def _pr_reviewers(spark, sf):
    return review.pr_reviewers(_with_repo(_fixes(spark, sf)), PATH_RULES, "repo")


@query("pr_plan")
def _pr_plan(spark, sf):
    return review.pr_plan(_with_repo(_fixes(spark, sf)), "repo")


@query("pr_body")
def _pr_body(spark, sf):
    """The text for the fix batch (at most ten fixes), with the totals of the scan."""
    totals = scan.totals(_CODE(spark, sf), _violations(spark, sf))
    batch = _batch(spark, sf).withColumn("batch", F.lit("fixes"))
    return review.pr_body(batch, "batch", variant="web", totals=totals.withColumn("batch", F.lit("fixes"))).select("body")


@query("pr_body_lines")
def _pr_body_lines(spark, sf):
    """The texts for all fixes of every repository, as ordered pieces."""
    return review.pr_body_lines(_with_repo(_fixes(spark, sf)), "repo").select(
        "repo", "part", "ord.file_path", "ord.detector_ord", F.col("ord.emit_ord").cast("int").alias("emit_ord"), "text")


@query("pr_comment_body")
def _pr_comment(spark, sf):
    return review.pr_comment(scan.type_counts(_violations(spark, sf)))


@query("gate_decision")
def _gate(spark, sf):
    return scan.gate_decision(_CODE(spark, sf), _violations(spark, sf))


# --- prompts and replies ------------------------------------------------------------------------


def _prompt(rows: DataFrame) -> DataFrame:
    return rows.select("violation_id", "kind", "model", F.length("prompt").cast("bigint").alias("n_chars"), "input_hash")


@query("prompt_classify")
def _prompt_classify(spark, sf):
    return _prompt(replies.prompt_classify(_violations(spark, sf)))


@query("prompt_fix")
def _prompt_fix(spark, sf):
    return _prompt(replies.prompt_fix(_violations(spark, sf)))


@query("prompt_review")
def _prompt_review(spark, sf):
    return _prompt(replies.prompt_review(_fixes(spark, sf)))


@query("prompt_pr_description")
def _prompt_pr(spark, sf):
    return replies.prompt_pr_description(_batch(spark, sf).withColumn("batch", F.lit("fixes")), "batch").select("prompt")


REPLY_BODY = {
    "classify": "concat('{\"banking_risk_explanation\": \"', if(line_number % 4 = 0, '', concat('risk ', "
                "line_number)), '\", \"severity\": \"LOW\", \"confidence_score\": ', "
                "if(line_number % 5 = 0, '0', '0.5'), '}')",
    "fix": "concat('{\"fixed_code\": \"', if(line_number % 3 = 0, 'eval(', 'safe('), line_number, "
           "')\", \"explanation\": \"why ', line_number, '\", \"confidence_score\": ', "
           "if(line_number % 2 = 0, '0.75', '0.5'), '}')",
    "review": "concat('{\"approved\": ', if(line_number % 5 = 1, 'false', 'true'), "
              "', \"review_notes\": \"note ', line_number, '\", \"issues\": [', "
              "if(line_number % 2 = 0, '{\"severity\": \"LOW\", \"issue\": \"x\"}, {\"issue\": \"y\"}', ''), ']}')",
}
REPLY_SHAPE = (
    "CASE WHEN line_number % 7 = 3 THEN '' ELSE CASE line_number % 6 WHEN 0 THEN body "
    "WHEN 1 THEN concat('```json\\n', body, '\\n```') "
    "WHEN 2 THEN concat('Here it is.\\n```\\n', body, '\\n```\\nDone') "
    "WHEN 3 THEN concat('Result: ', body, ' end') WHEN 4 THEN 'no answer' ELSE '[1, 2]' END END"
)


def derived_replies(violations: DataFrame, kind: str) -> DataFrame:
    """Replies whose form (plain, fenced, embedded, broken, failed) depends on the line number."""
    return (
        violations.select("line_number", violation_id(
            F.col("file_path"), F.col("line_number"), F.col("violation_type")).alias("violation_id"))
        .withColumn("body", F.expr(REPLY_BODY[kind]))
        .select("violation_id", F.lit(kind).alias("kind"), F.expr(REPLY_SHAPE).alias("content"),
                F.expr("if(line_number % 7 = 3, 'timeout', cast(null as string))").alias("error"))
    )


@query("reply_parse_json")
def _parse_json(spark, sf):
    parsed = replies.parsed_replies(
        derived_replies(_violations(spark, sf), "fix"), "fixed_code string, confidence_score double")
    return parsed.select("violation_id", F.col("r.fixed_code").alias("fixed_code"),
                         F.col("r.confidence_score").alias("score"),
                         F.col("parse_error").isNotNull().alias("failed"))


@query("reply_classify_merge")
def _classify_merge(spark, sf):
    v = _violations(spark, sf)
    return replies.merge_classification(v, derived_replies(v, "classify")).select(
        "violation_id", "severity", "description", "confidence_score")


@query("reply_fix_merge")
def _fix_merge(spark, sf):
    return _model_fixes(spark, sf).select(
        "violation_id", "original_code", "fixed_code", "explanation", "fix_confidence",
        "security_review_passed", "security_review_notes")


@query("reply_review_merge")
def _review_merge(spark, sf):
    v = _violations(spark, sf)
    return replies.merge_reviews(_model_fixes(spark, sf), derived_replies(v, "review")).select(
        "violation_id", "security_review_passed", "security_review_notes")


@query("ai_run")
def _ai_run(spark, sf):
    v = stored(_violations(spark, sf), "violations")  # one scan for all branches
    return replies.run(v, derived_replies(v, "classify"), derived_replies(v, "fix"),
                       derived_replies(v, "review")).select(
        "violation_id", "description", "fixed_code", "security_review_notes")


@query("ai_stats")
def _ai_stats(spark, sf):
    v = stored(_violations(spark, sf), "violations")
    fixes = stored(replies.merge_fixes(v, derived_replies(v, "fix")), "fixes")
    reviewed = replies.merge_reviews(fixes, derived_replies(v, "review")).where("security_review_passed")
    return replies.run_stats(v, fixes, reviewed)
