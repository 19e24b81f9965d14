"""Scanning files as they arrive.

The line rules are a narrow projection, so they run on a stream as they are; flow checks
use windows over a file and therefore run per micro-batch (a file is never split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import decode_source
from ..operators.scan import gate_decision, scan, scan_lines
from ..session import stored

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, max_kb: int | None = None,
                max_files_per_trigger: int = 10_000) -> DataFrame:
    """New source files below a folder; with ``max_kb`` none that are larger."""
    files = (
        spark.readStream.format("binaryFile").schema(_BINARY)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(max_files_per_trigger)).load(folder)
    )
    if max_kb is not None:
        files = files.where(F.col("length") <= max_kb * 1024)
    return files.select(F.col("path").alias("file_path"), decode_source(F.col("content")).alias("content"))


def table_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of a table of (file_path, content)."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(path))


def scan_lines_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Line rules as an append-only query with an exactly-once parquet sink."""
    return (
        scan_lines(files).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def scan_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Full scan per micro-batch; a repeated batch overwrites its own folder."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (files.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def scan_gate_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Full scan and gate decision of every artefact once, however often it is delivered.

    State is one row for each path and SHA-256 of its content, so a delivery is dropped if the same
    content came before, and a file with new content is scanned again. ``out`` has
    ``violations`` and ``gate``, both with content_hash; a repeated batch overwrites its own folders.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        # the versions of a path that one batch delivers are scanned one after the other, usually one
        same = Window.partitionBy("file_path").orderBy("content_hash")
        versions = stored(batch.select("file_path", "content_hash").withColumn(
            "version", F.row_number().over(same)), "versions")
        for version in range(1, (versions.agg(F.max("version")).first()[0] or 0) + 1):
            own = versions.where(F.col("version") == version).drop("version")
            only = batch.join(own, ["file_path", "content_hash"], "left_semi")
            place = f"batch={batch_id}/version={version}"
            scan(only.drop("content_hash")).join(own, "file_path").write.mode("overwrite").parquet(
                f"{out}/violations/{place}")
            found = batch.sparkSession.read.parquet(f"{out}/violations/{place}")
            gate_decision(only, found, "file_path", "content_hash").write.mode("overwrite").parquet(f"{out}/gate/{place}")
        batch.unpersist()

    once = files.select("file_path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    return (once.dropDuplicates(["file_path", "content_hash"]).writeStream.foreachBatch(one_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
