"""The scan: files to violations in one narrow stage, then deduplication and statistics.

Per file row the text is folded once, lines without any rule word are dropped by plain
substring tests, and only the remaining candidate lines are exploded together with the
few neighbouring lines the rules and contexts need.  No shuffle happens before the
optional merge with the flow checks, whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import HIGH, MONGODB, SEVERITY_OF_TYPE
from ..functions.lang import (
    concat_language, is_mongo_file, platform, route_language, rule_language,
)
from ..functions.text import (
    NOCASE_DOTALL, fold_sql, is_blank, quote, split_lines, strip, strip_sql,
)
from .lines import UNBATCHED_WINDOW, context_after, context_before, window_text
from .rules import (
    DETECTORS, LOOP_RULES, RULES, UNBATCHED_TEXT, WindowRule, contains_any, gate_condition,
    route_condition, rule_condition, search, window_column, windows_of,
)

VIOLATION_COLUMNS = (
    "file_path", "line_number", "line_content", "violation_type", "severity", "platform",
    "language", "description", "context_before", "context_after", "confidence_score",
)
ORDER_COLUMNS = ("detector_ord", "emit_ord")
_FILE_COLUMNS = (
    "file_path", "route_language", "rule_language", "concat_language", "platform_base",
    "platform_select", "platform_longtxn", "platform_mongo", "is_mongo",
)


def with_file_columns(files: DataFrame) -> DataFrame:
    """Languages, platforms and gates, once per file."""
    if "route_language" not in files.columns:
        files = files.withColumn("route_language", route_language())
    return files.where("route_language is not null").select(
        "file_path", "route_language", "content",
        rule_language().alias("rule_language"),
        concat_language().alias("concat_language"),
        platform().alias("platform_base"),
        platform(variant="select").alias("platform_select"),
        platform(variant="longtxn").alias("platform_longtxn"),
        F.lit(MONGODB).alias("platform_mongo"),
        is_mongo_file().alias("is_mongo"),
    )


_NO_LINES = "cast(array() as array<int>)"


def _matching_windows(rule: WindowRule) -> str:
    """Ascending numbers of the lines whose 16-line window matches a loop rule.

    Only windows that hold a line with one of the rule's call words are tested.
    """
    calls = (
        f"filter(sequence(1, size(folds)), n -> "
        f"{contains_any('element_at(folds, n)', rule.call_words)})"
    )
    near = (
        f"array_distinct(flatten(transform({calls}, "
        f"n -> sequence(greatest(n - {UNBATCHED_WINDOW[1]}, 1), n))))"
    )
    return f"filter({near}, n -> {search(window_text(UNBATCHED_WINDOW), rule.pattern, NOCASE_DOTALL)})"


def _loop_lines(loop_rules) -> str:
    whens = " ".join(
        f"WHEN rule_language = {quote(r.language)} THEN {_matching_windows(r)}" for r in loop_rules)
    return (
        f"CASE WHEN NOT ({route_condition(DETECTORS['unbatched'])}) THEN {_NO_LINES} "
        f"{whens} ELSE {_NO_LINES} END"
    )


# of ascending line numbers, the first of each group of ten
_FIRST_PER_BUCKET = (
    "filter(loop_all, (n, i) -> i = 0 OR n div 10 <> get(loop_all, i - 1) div 10)"
)


def loop_matches(files: DataFrame, loop_rules=LOOP_RULES) -> DataFrame:
    """Every line whose window matches a loop rule, before one per ten lines is kept."""
    return (
        with_file_columns(files)
        .select("file_path", "route_language", "rule_language",
                split_lines(F.col("content")).alias("lines"),
                F.expr(f"split({fold_sql('content')}, '\\n', -1)").alias("folds"))
        .select("file_path", F.expr(f"explode({_loop_lines(loop_rules)})").alias("line_number"))
    )


def language_routes(files: DataFrame) -> DataFrame:
    """(file_path, detector): which detectors see a file."""
    names = ", ".join(
        f"CASE WHEN {route_condition(d)} THEN '{name}' END" for name, d in DETECTORS.items())
    flow = "CASE WHEN route_language IN ('C#', 'JAVA', 'PYTHON') THEN 'flow' END"
    return (
        with_file_columns(files)
        .select("file_path", F.expr(f"explode(array({names}, {flow}))").alias("detector"))
        .where("detector is not null")
    )


def candidate_lines(files: DataFrame, rules=RULES, loop_rules=LOOP_RULES,
                    strict_blank: bool = True) -> DataFrame:
    """Lines on which some rule may match, with windows and contexts."""
    df = with_file_columns(files).withColumn("folded", F.expr(fold_sql("content")))

    # files without any rule word never get split
    gates = [gate_condition(rules, "folded")] if rules else []
    gates += [
        f"(rule_language = {quote(r.language)} AND {contains_any('folded', r.call_words)})"
        for r in loop_rules
    ]
    df = df.where(" OR ".join(gates)).select(
        *_FILE_COLUMNS, split_lines(F.col("content")).alias("lines"),
        split_lines(F.col("folded")).alias("folds"),
    )

    loops = _NO_LINES
    if loop_rules:
        df = df.withColumn("loop_all", F.expr(_loop_lines(loop_rules)))
        df = df.withColumn("loop_first", F.expr(_FIRST_PER_BUCKET))
        loops = "loop_first"
        if strict_blank:
            # one blank reported line discards the loop findings of the whole file
            loops = (
                f"CASE WHEN exists(loop_first, n -> {strip_sql('element_at(lines, n)')} = '') "
                f"THEN {_NO_LINES} ELSE loop_first END"
            )
    df = df.withColumn("loops", F.expr(loops))

    gated = _NO_LINES
    if rules:
        gated = (
            f"filter(sequence(1, size(folds)), n -> {gate_condition(rules, 'element_at(folds, n)')})"
        )
    fields = {
        "line_number": "n", "line": "element_at(lines, n)", "is_loop": "array_contains(loops, n)",
        "context_before": context_before(), "context_after": context_after(),
        **{window_column(w): window_text(w) for w in windows_of(rules)},
    }
    pairs = ", ".join(f"'{name}', {expr}" for name, expr in fields.items())
    return df.select(*_FILE_COLUMNS, F.expr(
        f"explode(transform(array_union({gated}, loops), n -> named_struct({pairs})))"
    ).alias("c")).select(*_FILE_COLUMNS, "c.*")


def _hit(detector_name: str, condition: str, description: str) -> str:
    det = DETECTORS[detector_name]
    level = SEVERITY_OF_TYPE.get(det.violation_type, HIGH)
    return (
        f"CASE WHEN {condition} THEN named_struct('violation_type', '{det.violation_type}', "
        f"'severity', '{level}', 'platform', platform_{det.platform}, "
        f"'language', {det.language}_language, 'description', {quote(description)}, "
        f"'confidence_score', {det.confidence}D, 'detector_ord', {det.ord}) END"
    )


def scan_lines(files: DataFrame, rules=RULES, loop_rules=LOOP_RULES,
               strict_blank: bool = True) -> DataFrame:
    """Violations of the line and loop rules: one narrow stage, no exchange."""
    candidates = candidate_lines(files, rules, loop_rules, strict_blank)
    by_detector: dict[str, list[str]] = {}
    for rule in rules:
        by_detector.setdefault(rule.detector, []).append(
            _hit(rule.detector, rule_condition(rule), rule.description))
    if loop_rules:
        by_detector["unbatched"] = [_hit("unbatched", "is_loop", UNBATCHED_TEXT)]
    # at most one hit per detector and line: the first branch that matches
    per_detector = [
        f"coalesce({', '.join(branches)})"
        for _, branches in sorted(by_detector.items(), key=lambda kv: DETECTORS[kv[0]].ord)
    ]
    return (
        candidates.select(
            "file_path", "line_number", "line", "context_before", "context_after",
            F.expr(f"explode(array({', '.join(per_detector)}))").alias("hit"),
        )
        .where("hit is not null")
        .select("file_path", "line_number", strip(F.col("line")).alias("line_content"),
                "hit.violation_type", "hit.severity", "hit.platform", "hit.language",
                "hit.description", "context_before", "context_after", "hit.confidence_score",
                "hit.detector_ord", F.col("line_number").alias("emit_ord"))
    )


def dedup(hits: DataFrame) -> DataFrame:
    """First hit per (file, type, line) in detector order.

    The key holds the line, so no key can collect more than a handful of rows.
    """
    w = Window.partitionBy("file_path", "violation_type", "line_number").orderBy(*ORDER_COLUMNS)
    return hits.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def scan(files: DataFrame, flow: bool = True, strict_blank: bool = True) -> DataFrame:
    """All violations of a corpus. With ``flow`` the statement and scope checks are merged in."""
    hits = scan_lines(files, strict_blank=strict_blank)
    if not flow:
        return hits  # one detector per type: already unique
    from .flow import flow_violations

    return dedup(hits.unionByName(flow_violations(files)))


def validate(violations: DataFrame) -> DataFrame:
    """Adds is_valid; rows that fail belong in quarantine."""
    ok = (
        ~is_blank(F.col("file_path")) & ~is_blank(F.col("line_content"))
        & ~is_blank(F.col("description")) & (F.col("line_number") >= 1)
        & F.col("confidence_score").between(0.0, 1.0)
    )
    return violations.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def split_quarantine(violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate(violations)
    return checked.where("is_valid").drop("is_valid"), checked.where("not is_valid").drop("is_valid")


def export_rows(violations: DataFrame, root: str = "") -> DataFrame:
    """Flat rows with relative path, file name and the line cut at 150 characters."""
    from ..functions.text import base_name, relative_path

    rel = relative_path(F.col("file_path"), F.lit(root)) if root else F.col("file_path")
    return violations.select(
        "file_path", rel.alias("relative_path"), base_name(F.col("file_path")).alias("file_name"),
        "line_number", F.substring("line_content", 1, 150).alias("line_content"),
        "violation_type", "severity", "platform", "language", "description", "confidence_score",
    )


FACETS = ("violation_type", "severity", "platform", "language")


def facet_counts(violations: DataFrame, facet: str) -> DataFrame:
    return violations.groupBy(facet).agg(F.count(F.lit(1)).alias("n"))


def all_facets(violations: DataFrame, *keys: str) -> DataFrame:
    """(facet, value, n) for all four facets from one pass and one aggregation."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in FACETS])
    return (
        violations.select(*keys, F.explode(pairs).alias("p"))
        .groupBy(*keys, "p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))
    )


def counts_by(violations: DataFrame, *keys: str) -> DataFrame:
    """(level, keys, facet, value, n): all facets and totals, of everything and of each key, in one pass.

    Grouping sets: every row is aggregated once, before the shuffle. ``level`` is "all" or "group"
    (then the keys are set), ``facet`` one of the four or "total" (its value is null).
    """
    levels = [[], list(keys)] if keys else [[]]
    sets = [[*level, *facet] for level in levels for facet in ([], *[[f] for f in FACETS])]
    marks = [F.grouping(c).alias(f"_{c}") for c in (*(keys[:1]), *FACETS)]
    counted = violations.groupingSets([[F.col(c) for c in s] for s in sets], *keys, *FACETS).agg(
        F.count(F.lit(1)).alias("n"), *marks)
    facet, value = F.lit("total"), F.lit(None).cast("string")
    for f in FACETS:
        facet = F.when(F.col(f"_{f}") == 0, F.lit(f)).otherwise(facet)
        value = F.when(F.col(f"_{f}") == 0, F.col(f)).otherwise(value)
    level = F.when(F.col(f"_{keys[0]}") == 0, F.lit("group")).otherwise("all") if keys else F.lit("all")
    return counted.select(level.alias("level"), *keys, facet.alias("facet"), value.alias("value"), "n")


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of several batches added up; counts of disjoint files merge to those of all."""
    return counts.groupBy(*[c for c in counts.columns if c != "n"]).agg(F.sum("n").alias("n"))


class CountTable:
    """Statistics of a growing corpus: the counts of each batch, merged when read.

    A batch is as many rows as it has groups, whatever its files; one written again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, *keys: str):
        self.spark, self.path, self.keys = spark, path, keys

    def add(self, batch: str, violations: DataFrame) -> None:
        counts_by(violations, *self.keys).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def counts(self) -> DataFrame:
        return merged_counts(self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").drop("batch"))


def totals(files: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: scanned files (clean ones too) and violations."""
    scanned = files if "route_language" in files.columns else files.withColumn(
        "route_language", route_language())
    marks = scanned.where("route_language is not null").select(F.lit("file").alias("kind")).unionByName(
        violations.select(F.lit("violation").alias("kind")))
    return marks.agg(
        F.count_if(F.col("kind") == "file").alias("total_files_scanned"),
        F.count_if(F.col("kind") == "violation").alias("total_violations"))


def type_counts(violations: DataFrame) -> DataFrame:
    """Count per type with the place of its first finding, which breaks ties."""
    first = F.min(F.struct("file_path", "detector_ord", "emit_ord"))
    return (
        violations.groupBy("violation_type")
        .agg(F.count(F.lit(1)).alias("n"), first.alias("first_seen"))
        .withColumn("severity", F.lit(HIGH))
    )


def most_common_types(violations: DataFrame) -> DataFrame:
    """Most frequent type first, ties in order of first appearance."""
    return type_counts(violations).orderBy(F.desc("n"), "first_seen").drop("first_seen")


def gate_decision(files: DataFrame, violations: DataFrame, *keys: str) -> DataFrame:
    """Per artefact whether approval is required; artefacts without findings appear too."""
    keys = keys or ("file_path",)
    counts = violations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (
        files.select(*keys).distinct().join(counts, list(keys), "left")
        .select(*keys, F.coalesce("n", F.lit(0)).alias("violations"))
        .withColumn("approval_required", F.col("violations") > 0)
    )
