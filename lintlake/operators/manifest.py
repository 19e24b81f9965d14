"""Expected findings (manifest documents) and how a scan compares with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import (
    LONG_RUNNING_TXN, READ_PREFERENCE, SELECT_STAR, STRING_CONCAT_SQL, UNBATCHED_TXN,
)
from ..schema import MANIFEST

# manifest vocabulary -> violation type; other words have no rule
TYPE_OF_WORD = {
    "SELECT_STAR": SELECT_STAR,
    "SQL_INJECTION": STRING_CONCAT_SQL,
    "DYNAMIC_SQL_WITHOUT_BIND_VARIABLES": STRING_CONCAT_SQL,
    "UNBATCHED_UPDATES": UNBATCHED_TXN,
    "UNBATCHED_INSERT": UNBATCHED_TXN,
    "COMMIT_IN_LOOP": UNBATCHED_TXN,
    "CURSOR_LOOP_UPDATE": UNBATCHED_TXN,
    "NO_BULK_WRITE": UNBATCHED_TXN,
    "NO_TIMEOUT": LONG_RUNNING_TXN,
    "NO_FAST_FORWARD_CURSOR": LONG_RUNNING_TXN,
    "NO_READ_PREFERENCE": READ_PREFERENCE,
}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents, indented, one per file; ``manifest`` is the file's path."""
    return (spark.read.schema(MANIFEST).option("multiLine", "true")
            .option("recursiveFileLookup", "true").json(path)
            .withColumn("manifest", F.col("_metadata.file_path")))


def _keyed(manifests: DataFrame) -> DataFrame:
    """Documents that were not read from files are taken as one manifest."""
    return manifests if "manifest" in manifests.columns else manifests.withColumn("manifest", F.lit(""))


def items(manifests: DataFrame) -> DataFrame:
    """One row per expected finding, with numeric line bounds; ids are those of one manifest."""
    bounds = F.split("i.line_range", "-")
    return (
        _keyed(manifests).select("manifest", F.explode("violations").alias("i"))
        .select("manifest", "i.*", bounds[0].cast("int").alias("lo"),
                F.element_at(bounds, -1).cast("int").alias("hi"))
    )


_SUMMARIES = {"violation_type": "violation_type_summary", "severity": "severity_summary",
              "database_platform": "platform_summary"}


def summary_check(manifests: DataFrame) -> DataFrame:
    """Stored against recomputed counts per manifest and facet value, with the difference."""
    stored = None
    for facet, column in _SUMMARIES.items():
        part = _keyed(manifests).select("manifest", F.lit(facet).alias("facet"), F.explode(column).alias("value", "n"))
        stored = part if stored is None else stored.unionByName(part)
    stored = stored.groupBy("manifest", "facet", "value").agg(F.sum("n").alias("stored"))
    listed = (
        items(manifests)
        .select("manifest", F.explode(F.array(*[
            F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in _SUMMARIES])).alias("p"))
        .groupBy("manifest", "p.facet", "p.value").agg(F.count(F.lit(1)).alias("listed"))
    )
    return (
        stored.join(listed, ["manifest", "facet", "value"], "full_outer")
        .select("manifest", "facet", "value", F.coalesce("stored", F.lit(0)).alias("stored"),
                F.coalesce("listed", F.lit(0)).alias("listed"))
        .withColumn("difference", F.col("stored") - F.col("listed"))
    )


def _within(path: str, root: str) -> Column:
    """A path below ``root``, whether it is written with the root or without it."""
    start = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(start)), F.substr(path, F.lit(len(start) + 1))).otherwise(F.col(path))


def match(expected: DataFrame, violations: DataFrame, root: str = "") -> DataFrame:
    """Adds to every expected finding whether the scan has one of its type in its lines.

    An interval sweep for each file and type: a range is its two ends, whatever its length, and it
    is matched when more findings have been passed at its last line than before its first.  With
    ``root``, paths below it meet whether they are absolute or relative.  A range without numbers
    matches nothing; one written backwards is turned round.
    """
    whens = " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in TYPE_OF_WORD.items())
    mapped = expected.withColumn("mapped_type", F.expr(f"CASE violation_type {whens} END"))
    start, finding, end = 0, 1, 2  # on one line in this order
    ends = mapped.where("mapped_type is not null AND lo is not null AND hi is not null").select(
        "manifest", "violation_id", "lo", "hi", _within("file", root).alias("path"), "mapped_type",
        F.explode(F.array(F.struct(F.least("lo", "hi").alias("at"), F.lit(start).alias("kind")),
                          F.struct(F.greatest("lo", "hi").alias("at"), F.lit(end).alias("kind")))).alias("e"),
    ).select("manifest", "violation_id", "lo", "hi", "path", "mapped_type", "e.*")
    findings = violations.select(
        _within("file_path", root).alias("path"), F.col("violation_type").alias("mapped_type"),
        F.col("line_number").cast("int").alias("at"), F.lit(finding).alias("kind"))
    passed = Window.partitionBy("path", "mapped_type").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.unionByName(findings, allowMissingColumns=True).withColumn(
        "passed", F.count_if(F.col("kind") == finding).over(passed))
    found = (
        swept.where(F.col("kind") != finding)
        .groupBy("manifest", "violation_id", "path", "mapped_type", "lo", "hi")
        .agg((F.max("passed") > F.min("passed")).alias("matched"))
        .groupBy("manifest", "violation_id").agg(F.max("matched").alias("matched"))
    )
    return mapped.join(found, ["manifest", "violation_id"], "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False)))


def recall(matched: DataFrame) -> DataFrame:
    """Expected and found per mapped type (null: words without a rule)."""
    return matched.groupBy("mapped_type").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("matched").alias("found"))
