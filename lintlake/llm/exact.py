"""Exact duplicates by a persistent digest index.

The index is a Parquet table bucketed and sorted by SHA-256 digest, so new data meets it in a
sort-merge anti-join without shuffling the index again.  New data is first aggregated to one
row for each digest (map-side combine), digests that the index knows are dropped by the
anti-join and the rest is appended.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import written


class DigestIndex:
    """One row for each text known: digest, keep_id, group_size, same_id, batch.

    ``group_size`` counts the rows of the batch that brought the text, ``same_id`` those that
    also carry keep_id.  The number of buckets is fixed when the index is made and stored beside
    it, so another session opens it by its path alone; another number raises.  The table is named
    by a digest of the whole path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._stored_buckets(buckets)
        self.table = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table}
            (digest BINARY, keep_id BIGINT, group_size BIGINT, same_id BIGINT, batch STRING) USING parquet
            CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'""")

    def _stored_buckets(self, wanted: int | None) -> int:
        layout = f"{self.path}.layout"
        try:
            stored = self.spark.read.schema("buckets int").parquet(layout).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = None
        if stored is None:
            buckets = wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(layout)
            return buckets
        if wanted not in (None, stored.buckets):
            raise ValueError(f"the index at {self.path} has {stored.buckets} buckets, not {wanted}")
        return stored.buckets

    def rows(self) -> DataFrame:
        """The bucketed table: joins on digest do not shuffle it."""
        return self.spark.table(self.table)

    def unbucketed(self) -> DataFrame:
        """The same rows as plain files, for joins in which Spark has to split skewed keys."""
        return self.spark.read.schema(self.rows().schema).parquet(self.path)

    def append(self, groups: DataFrame, batch: str) -> DataFrame:
        """Adds the groups (one row a digest) that are new; returns all that this batch brought.

        A batch that is given again, as by a job that died after its append, finds its own rows.
        """
        self.spark.catalog.refreshTable(self.table)
        fresh = written(groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti"), "fresh")
        (fresh.select("digest", "keep_id", "group_size", "same_id", F.lit(batch).alias("batch"))
         .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
         .option("path", self.path).saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)
        return self.unbucketed().where(F.col("batch") == batch)


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def text_groups(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) rows to one row for each digest; the largest doc_id stays."""
    by_id = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    return by_id.groupBy("digest").agg(
        F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("group_size")).select(
        "digest", F.col("top.doc_id").alias("keep_id"), "group_size", F.col("top.n").alias("same_id"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any
    other; of repeated rows (same doc_id, same text) one stays.  Null and empty texts are one
    group.  With an index that already knows a text, keep_id is the row that brought it and
    no new row is kept.  ``batch`` names the rows in the index: given again with the same rows, it
    has the same result; without it every call is a batch of its own.  Other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch_dir(spark, "digest-index"))
    rows = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                               digest(F.col("text")).alias("digest")), "digests")
    batch = batch or uuid.uuid4().hex
    index.append(text_groups(rows), batch)
    by_id = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    # repeated rows were folded into counts: only their first can stay
    labelled = by_id.join(index.unbucketed(), "digest").withColumn(
        "turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return labelled.select(
        "doc_id", "keep_id", "group_size",
        ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
         & (F.col("turn") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Cases as in :func:`exact_duplicates`.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch_dir(spark, "digest-index"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("keep_id"),
                       digest(F.col("text")).alias("digest"))
    groups = written(text_groups(rows.select(F.col("keep_id").alias("doc_id"), "digest")), "groups")
    fresh = index.append(groups, batch or uuid.uuid4().hex)
    same = rows.alias("r").join(
        fresh.alias("f"), (F.col("r.digest") == F.col("f.digest"))
        & F.col("r.keep_id").eqNullSafe(F.col("f.keep_id"))).select("row", "f.digest", "same_id")
    single, several = same.where("same_id = 1"), same.where("same_id > 1")
    if groups.where("same_id > 1").isEmpty():
        return single.select("row.*")
    return single.select("row.*").union(several.dropDuplicates(["digest"]).select("row.*"))
