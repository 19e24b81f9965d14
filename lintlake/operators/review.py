"""Reviewers, pull-request plans and the texts that go with them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import DEFAULT_REVIEWER, DRAFT_BELOW_CONFIDENCE, PR_LABELS
from ..functions.text import base_name, quote, whole_percent
from .folding import MAX_TEXT_BYTES, fold_texts

GENERATOR = "lintlake"


def glob_regex(glob: str) -> str:
    """Shell glob as a regex for the whole path; ``*`` crosses folders."""
    out, i = "", 0
    while i < len(glob):
        char = glob[i]
        close = glob.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out += ".*"
        elif char == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1:close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = close
        else:
            out += re.escape(char)
        i += 1
    return f"(?s)^{out}\\z"


def glob_anchor(glob: str) -> tuple[str, str]:
    """The longer of the literal texts that every match begins ("p") or ends ("s") with."""
    prefix = re.match(r"[^*?\[]*", glob).group()
    suffix = re.search(r"[^*?\[\]]*\Z", glob).group()
    return ("s", suffix) if len(suffix) > len(prefix) else ("p", prefix)


def reviewer_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Ordered (glob, reviewer) configuration as rows, with what :func:`reviewers_by_table` looks up."""
    return spark.createDataFrame(
        [(i, glob, glob_regex(glob), who, *glob_anchor(glob)) for i, (glob, who) in enumerate(rules, 1)],
        "ord int, glob string, regex string, reviewer string, anchor string, literal string")


#: A table of at most so many globs is sent to every executor; a larger one is joined by shuffling.
MAX_BROADCAST_RULES = 100_000


def reviewers_by_table(files: DataFrame, rules: DataFrame, default: str = DEFAULT_REVIEWER) -> DataFrame:
    """(file_path, reviewer) for every distinct path: the first matching glob of a table of any size.

    A glob is found by its literal beginning or end: a path looks up its own beginnings and ends of
    the lengths that the table has, and only globs found are matched. One without either is matched
    against every path. Same result as :func:`reviewer_for_path`, whose one CASE stops
    compiling at some thousand globs.
    """
    # as many rows as there are lengths of literals, two kinds of at most a path's length each
    lengths = rules.select("anchor", F.length("literal").alias("n")).distinct().collect()

    def looked_up(kind: str, cut: str) -> str:
        sizes = sorted(r["n"] for r in lengths if r["anchor"] == kind)
        numbers = f"array({', '.join(map(str, sizes))})" if sizes else "cast(array() as array<int>)"
        return (f"transform(filter({numbers}, n -> n <= length(file_path)), n -> "
                f"named_struct('anchor', '{kind}', 'literal', {cut}))")

    paths = files.select("file_path").distinct()
    looked = paths.select("file_path", F.expr(
        f"explode(concat({looked_up('p', 'substring(file_path, 1, n)')}, "
        f"{looked_up('s', 'substring(file_path, length(file_path) - n + 1, n)')}))").alias("l")).select("file_path", "l.*")
    table = rules.select("anchor", "literal", "regex", "ord", "reviewer")
    if table.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES:
        table = F.broadcast(table)
    hits = looked.join(table, ["anchor", "literal"]).where("file_path rlike regex").select("file_path", "ord", "reviewer")
    everyone = paths.select("file_path", F.lit(None).cast("int").alias("ord"), F.lit(default).alias("reviewer"))
    first = F.min_by("reviewer", F.struct(F.col("ord").isNull(), "ord"))
    return hits.unionByName(everyone).groupBy("file_path").agg(first.alias("reviewer"))


def reviewer_for_path(rules: list[tuple[str, str]], default: str = DEFAULT_REVIEWER,
                      path: str = "file_path") -> Column:
    """First matching glob in configuration order, else the default.

    The rules are configuration, so they become one CASE: no join, each path is seen once.
    """
    whens = " ".join(
        f"WHEN {path} RLIKE {quote(glob_regex(glob))} THEN {quote(who)}" for glob, who in rules)
    return F.expr(f"CASE {whens} ELSE {quote(default)} END") if rules else F.lit(default)


def reviewers_for_type(rules: dict[str, str | list[str]], default: str = DEFAULT_REVIEWER) -> Column:
    """array<string> of the reviewers of a violation type."""
    whens = " ".join(
        f"WHEN {quote(t)} THEN array({', '.join(quote(w) for w in ([who] if isinstance(who, str) else who))})"
        for t, who in rules.items() if who)
    return F.expr(f"CASE violation_type {whens} ELSE array({quote(default)}) END") if whens \
        else F.array(F.lit(default))


def pr_reviewers(fixes: DataFrame, rules: list[tuple[str, str]], *keys: str,
                 default: str = DEFAULT_REVIEWER) -> DataFrame:
    """Distinct reviewers per pull request, sorted; their number is bounded by the configuration."""
    return (
        fixes.select(*keys, reviewer_for_path(rules, default).alias("reviewer"))
        .groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("reviewer")), ",").alias("reviewers"))
    )


def pr_plan(fixes: DataFrame, *keys: str, labels: tuple[str, ...] = PR_LABELS) -> DataFrame:
    """Title, draft flag and labels per pull request."""
    types = F.array_join(F.sort_array(F.collect_set("violation_type")), ", ")
    return (
        fixes.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("fixes"), F.avg("fix_confidence").alias("avg_confidence"),
             types.alias("types"))
        .select(
            *keys, "fixes",
            F.concat(F.lit("DB Hygiene: Fix "), F.col("fixes").cast("string"), F.lit(" violations ("),
                     F.col("types"), F.lit(")")).alias("title"),
            (F.col("avg_confidence") < DRAFT_BELOW_CONFIDENCE).alias("is_draft"),
            F.lit(",".join(labels)).alias("labels"),
        )
    )


# The parts of the texts around the table.
_BODY = {
    "library": {
        "intro": "## DB Hygiene Automated Fix\n\nThis PR addresses **%s** database hygiene violations "
                 "detected by the automated scanner.\n\n",
        "head": "### Fixes Applied\n\n| File | Violation | Confidence |\n|------|-----------|------------|\n",
        "tail": "\n### Testing Recommendations\n\n"
                "- [ ] Verify all fixes compile and pass existing tests\n"
                "- [ ] Review each fix for business logic preservation\n"
                "- [ ] Run integration tests against test database\n"
                "\n---\n*Generated by %s*\n",
    },
    "web": {
        "intro": "## DB Hygiene Automated Fix\n\nThis PR addresses **%s** database hygiene violations "
                 "detected and fixed by the automated scanner.\n\n",
        "summary": "### Scan Summary\n- **%s** total violations found\n- **%s** files scanned\n\n",
        "head": "### Fixes Applied\n\n| File | Violation | Confidence |\n|------|-----------|------------|\n",
        "tail": "\n### Review Checklist\n"
                "- [ ] Verify fixes compile and pass tests\n"
                "- [ ] Review business logic preservation\n"
                "- [ ] Run integration tests\n"
                "\n---\n*Generated by %s*\n",
    },
}
_COMMENT_HEAD = "## DB Hygiene Scan Results\n\n"
_COMMENT_NONE = "No violations detected.\n"
_COMMENT_SOME = "**%s violation(s) detected**\n\n| Type | Count | Severity |\n|------|-------|----------|\n"
_COMMENT_TAIL = "\n---\n*Generated by %s*"


def _fill(template: str, *values: Column) -> Column:
    parts = template.split("%s")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:]):
        out += [value.cast("string"), F.lit(rest)]
    return F.concat(*out)


def _table_row(variant: str) -> Column:
    shown = base_name(F.col("file_path")) if variant == "web" else F.col("file_path")
    return F.concat(
        F.lit("| "), shown, F.lit(":"), F.col("line_number").cast("string"), F.lit(" | "),
        F.col("violation_type"), F.lit(" | "), whole_percent(F.col("fix_confidence")), F.lit(" |\n"))


def pr_body_lines(fixes: DataFrame, *keys: str, variant: str = "library",
                  totals: DataFrame | None = None, generator: str = GENERATOR) -> DataFrame:
    """The body of each pull request as ordered pieces (keys, part, ord, text).

    Written in order, the pieces are the text.  A repository with any number of fixes stays
    distributed, because no row ever holds more than one table line.
    """
    text = _BODY[variant]
    counts = fixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    intro = _fill(text["intro"], F.col("n"))
    if variant == "web" and totals is not None:
        both = counts.unionByName(totals, allowMissingColumns=True)
        counts = both.groupBy(*keys).agg(*[
            F.max(c).alias(c) for c in ("n", "total_violations", "total_files_scanned")])
        intro = F.concat(intro, _fill(text["summary"], F.col("total_violations"),
                                      F.col("total_files_scanned")))
    no_ord = F.struct(F.lit("").alias("file_path"), F.lit(0).alias("detector_ord"),
                      F.lit(0).cast("bigint").alias("emit_ord"))
    frame = counts.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(intro, F.lit(text["head"])).alias("text")),
        F.struct(F.lit(2).alias("part"), F.lit(text["tail"] % generator).alias("text")),
    )).alias("x")).select(*keys, "x.part", no_ord.alias("ord"), "x.text")
    rows = fixes.select(
        *keys, F.lit(1).alias("part"),
        F.struct("file_path", F.col("detector_ord").cast("int").alias("detector_ord"),
                 F.col("emit_ord").cast("bigint").alias("emit_ord")).alias("ord"),
        _table_row(variant).alias("text"))
    return frame.unionByName(rows)


def pr_body(fixes: DataFrame, *keys: str, max_bytes: int = MAX_TEXT_BYTES, **options) -> DataFrame:
    """(keys, part, parts, body): the body of each pull request, one string up to ``max_bytes`` bytes.

    A longer one comes as several numbered texts; without keys it raises.
    """
    pieces = pr_body_lines(fixes, *keys, **options)
    return fold_texts(pieces, *keys, order=F.struct("part", "ord"), text=F.col("text"),
                      max_bytes=max_bytes).withColumnRenamed("text", "body")


def pr_comment(type_counts: DataFrame, generator: str = GENERATOR) -> DataFrame:
    """The scan comment: at most one table line per violation type."""
    rows = F.sort_array(F.collect_list(F.struct(
        (-F.col("n")).alias("o"), "first_seen", "violation_type", "n")))
    table = F.array_join(F.transform(rows, lambda r: F.concat(
        F.lit("| "), r["violation_type"], F.lit(" | "), r["n"].cast("string"), F.lit(" | HIGH |\n"))), "")
    return type_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), table.alias("table")).select(
        F.concat(
            F.lit(_COMMENT_HEAD),
            F.when(F.col("total") == 0, F.lit(_COMMENT_NONE)).otherwise(
                F.concat(_fill(_COMMENT_SOME, F.col("total")), F.col("table"))),
            F.lit(_COMMENT_TAIL % generator),
        ).alias("body"))
