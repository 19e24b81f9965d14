"""Scan results as documents and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import VIOLATION_COLUMNS, all_facets
from ..schema import SCAN_RESULT

_BUCKETS = 1 << 20
_FACET_FIELDS = {
    "violation_type": "violations_by_type", "severity": "violations_by_severity",
    "platform": "violations_by_platform", "language": "violations_by_language",
}


def scan_documents(files: DataFrame, violations: DataFrame, repo: str = "repo",
                   max_rows: int | None = None) -> DataFrame:
    """One scan-result document per repository (repo_path, doc_no, violations, stats).

    A document is one row. Where the caller asks for it with ``max_rows``, a repository with
    more findings gets several documents: the first has the statistics, the others (doc_no
    from 1) only findings, so nothing is counted twice and no row grows without bound.
    Which document a finding goes to is settled on counts per hashed file (small rows), then
    the findings follow by an equi-join on that hash, however large their repository is.
    """
    entry = F.struct("file_path", "detector_ord", "emit_ord", F.struct(
        *VIOLATION_COLUMNS, F.lit(None).cast("timestamp").alias("created_at")).alias("v"))
    hashed = violations.withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(_BUCKETS)).cast("int"))
    w = Window.partitionBy(repo).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        hashed.groupBy(repo, "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("doc_no", F.floor((F.sum("n").over(w) - 1) / (max_rows or 1))).drop("n")
        # numbers follow each other from 0, also where one file has more than max_rows findings
        .withColumn("doc_no", F.dense_rank().over(Window.partitionBy(repo).orderBy("doc_no")) - 1)
    )
    numbered = violations.withColumn("doc_no", F.lit(0)) if max_rows is None else hashed.join(placed, [repo, "bucket"])
    packed = (
        numbered
        .groupBy(repo, "doc_no").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
        .select(repo, "doc_no", F.transform("rows", lambda r: r["v"]).alias("violations"))
    )
    facets = all_facets(violations, repo).groupBy(repo).agg(*[
        F.map_from_entries(F.sort_array(F.collect_list(
            F.when(F.col("facet") == facet, F.struct("value", "n"))))).alias(name)
        for facet, name in _FACET_FIELDS.items()])
    counts = violations.groupBy(repo).agg(F.count(F.lit(1)).alias("total_violations"))
    scanned = files.groupBy(repo).agg(F.count(F.lit(1)).alias("total_files_scanned"))
    empty_map = F.create_map().cast("map<string,bigint>")
    return (
        scanned.join(counts, repo, "left").join(facets, repo, "left").join(packed, repo, "left")
        .select(
            F.lit(None).cast("timestamp").alias("timestamp"), F.col(repo).alias("repo_path"),
            F.coalesce("doc_no", F.lit(0)).alias("doc_no"),
            F.coalesce("violations", F.array()).alias("violations"),
            F.when(F.coalesce("doc_no", F.lit(0)) == 0, F.struct(
                "total_files_scanned",
                F.coalesce("total_violations", F.lit(0)).alias("total_violations"),
                *[F.coalesce(F.col(name), empty_map).alias(name) for name in _FACET_FIELDS.values()],
                F.lit(None).cast("double").alias("scan_duration_seconds"),
            )).alias("stats"),
        )
    )


def write_scan_json(documents: DataFrame, path: str) -> None:
    """JSON lines, one document per line, with its number within the repository."""
    documents.write.mode("errorifexists").json(path)


def indented_json(documents: DataFrame) -> DataFrame:
    """(repo_path, doc_no, text) with the document as indented JSON."""
    return documents.select("repo_path", "doc_no", F.to_json(
        F.struct("timestamp", "repo_path", "violations", "stats"), {"pretty": "true"}).alias("text"))


def read_scan_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Saved documents: indented (one per file) or JSON lines."""
    return (spark.read.schema(SCAN_RESULT).option("multiLine", str(multi_line).lower())
            .option("recursiveFileLookup", "true").json(path))


def violations_of(documents: DataFrame) -> DataFrame:
    return documents.select("repo_path", F.explode("violations").alias("v")).select("repo_path", "v.*")
