"""Source trees as DataFrames, and back.

Listing and reading run on the executors.  The tree is listed one level per step, so the
work spreads over folders however lopsided the tree is, and names that start with a dot or
an underscore are kept (Spark's own file sources hide them).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import SKIP_DIRS
from ..functions.lang import route_language
from ..functions.text import decode_source
from ..session import cut_lineage

# the functions below run on executors, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENTRY = "path string, is_dir boolean, size_bytes bigint, modified double"
_ROWS_PER_BATCH = 10_000
_BYTES_PER_BATCH = 32 << 20


def local_path(path: str) -> str | None:
    """Path on a mounted file system, or None for an object-store or HDFS address."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return None if "://" in path else os.path.abspath(path)


def _entries(folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """(path, is_dir, size, mtime) of one folder.

    Only what is gone since its folder was listed is left out; any other error fails the task,
    so that it is tried again and nothing is missing without a message.
    """
    mounted = local_path(folder)
    if mounted is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        prefix = folder[: len(folder) - len(inner)]
        for info in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            yield (prefix + info.path, info.type == fs.FileType.Directory, info.size or 0,
                   (info.mtime_ns or 0) / 1e9)
        return
    try:
        found = os.scandir(mounted)
    except FileNotFoundError:
        return
    with found:
        for entry in found:
            path = f"{folder.rstrip('/')}/{entry.name}"
            try:
                if entry.is_dir():
                    if not entry.is_symlink():  # links to folders are not followed
                        yield path, True, 0, 0.0
                else:
                    stat = entry.stat()
                    yield path, False, stat.st_size, stat.st_mtime
            except FileNotFoundError:
                continue


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "is_dir", "size_bytes", "modified"]
    rows: list = []
    for batch in batches:
        for folder in batch["path"]:
            for row in _entries(folder):
                rows.append(row)
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _read_one(path: str) -> bytes | None:
    mounted = local_path(path)
    try:
        if mounted is not None:
            with open(mounted, "rb") as handle:
                return handle.read()
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner) as handle:
            return handle.read()
    except FileNotFoundError:
        return None  # gone since it was listed: reads as empty; other errors fail the task


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        start, held, data = 0, 0, []
        for i, path in enumerate(batch["path"]):
            data.append(_read_one(path))
            held += len(data[-1] or b"")
            if held >= _BYTES_PER_BATCH or i == len(batch) - 1:
                yield batch.iloc[start:i + 1].assign(data=data)
                start, held, data = i + 1, 0, []


def _file_name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


def list_tree(spark: SparkSession, root: str, skip_dirs=SKIP_DIRS) -> DataFrame:
    """All files below ``root``, folders in ``skip_dirs`` (exact names) not entered."""
    root = root.rstrip("/") or "/"
    level = spark.createDataFrame([(root,)], "path string")
    found = None
    while True:
        tasks = spark.sparkContext.defaultParallelism
        listed = cut_lineage(
            spark, level.repartition(tasks, "path").mapInPandas(_list_folders, _ENTRY))
        files = listed.where("NOT is_dir").drop("is_dir")
        found = files if found is None else found.unionByName(files)
        level = listed.where("is_dir").where(~_file_name().isin(*skip_dirs)).select("path")
        if level.isEmpty():
            return found


def _too_large(max_kb: int | None, size: str = "size_bytes") -> Column:
    return F.lit(False) if max_kb is None else F.col(size) > max_kb * 1024


def list_files(spark: SparkSession, root: str, max_kb: int | None = None) -> DataFrame:
    """All files with the reason why they are not scanned (null: they are)."""
    base = root.rstrip("/") + "/"
    return (
        list_tree(spark, root)
        .withColumn("route_language", route_language("path"))
        .select(
            F.col("path").alias("file_path"),
            F.expr(f"substring(path, {len(base) + 1})").alias("relative_path"),
            "route_language", "size_bytes",
            F.timestamp_micros((F.col("modified") * 1_000_000).cast("bigint")).alias("last_modified"),
            F.when(F.col("route_language").isNull(), "no known suffix")
            .when(_too_large(max_kb), "too large").alias("skipped"),
        )
    )


def skipped_files(spark: SparkSession, root: str, max_kb: int | None = None) -> DataFrame:
    """Files below ``root`` that a scan does not see, and why."""
    return list_files(spark, root, max_kb).where("skipped is not null").select(
        "file_path", "relative_path", "size_bytes", "skipped")


def discover_files(spark: SparkSession, root: str, max_kb: int | None = None,
                   only: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Scannable files: known suffix, skipped folders left out, with ``max_kb`` none that are larger."""
    files = list_files(spark, root, max_kb).where("skipped is null").drop("skipped")
    if only is not None:
        files = files.where(F.col("relative_path").isin(*only))
    return files.orderBy("file_path") if ordered else files


def read_files(found: DataFrame, truncate_kb: int | None = None) -> DataFrame:
    """Adds ``content``. Bytes are read on the executors, decoding is column work."""
    spark = found.sparkSession
    per_task = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    total = found.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // per_task), min(
        spark.sparkContext.defaultParallelism, 1 + total // (1 << 20)))
    # round robin instead of by key: one repository may hold a third of all files
    spread = found.withColumnRenamed("file_path", "path").repartition(int(tasks))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema.fields)
    return (
        spread.mapInPandas(_read_batches, schema + ", data binary")
        .withColumn("content", decode_source(F.col("data"), F.col("size_bytes"), truncate_kb))
        .drop("data").withColumnRenamed("path", "file_path")
    )


def _bytes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.lower().rstrip("b")
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def read_tree(spark: SparkSession, root: str, max_kb: int | None = None,
              only: list[str] | None = None) -> DataFrame:
    """Discover and read; the input of a scan."""
    return read_files(discover_files(spark, root, max_kb, only, ordered=False))


def read_visible(spark: SparkSession, root: str, max_kb: int | None = None) -> DataFrame:
    """Fast path with Spark's own file source, for trees without hidden names.

    Size and suffix are tested on metadata, so other files are never opened.
    """
    name_free = F.expr(
        "NOT arrays_overlap(slice(split(path, '/'), 1, size(split(path, '/')) - 1), array("
        + ", ".join(f"'{d}'" for d in SKIP_DIRS) + "))")
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .where(~_too_large(max_kb, "length"))
        .withColumn("route_language", route_language("path"))
        .where("route_language is not null").where(name_free)
        .select(F.col("path").alias("file_path"), "route_language",
                F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"),
                decode_source(F.col("content")).alias("content"))
    )


def _write_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = []
        for path, text in zip(batch["path"], batch["data"]):
            data = bytes(text)
            mounted = local_path(path)
            if mounted is None:
                from pyarrow import fs

                store, inner = fs.FileSystem.from_uri(path)
                store.create_dir(os.path.dirname(inner), recursive=True)
                with store.open_output_stream(inner) as handle:
                    handle.write(data)
            else:
                os.makedirs(os.path.dirname(mounted), exist_ok=True)
                # a task may run twice: write aside, then swap in
                partial = f"{mounted}.{os.getpid()}.part"
                with open(partial, "wb") as handle:
                    handle.write(data)
                os.replace(partial, mounted)
            sizes.append(len(data))
        yield pd.DataFrame({"path": batch["path"], "size_bytes": sizes})


def write_files(files: DataFrame, root: str | None = None, content: str = "content") -> int:
    """Write one file per row; returns how many. Content is text (UTF-8) or binary."""
    path = F.col("file_path") if root is None else F.concat(F.lit(root.rstrip("/") + "/"), "file_path")
    rows = files.select(path.alias("path"), F.col(content).cast("binary").alias("data"))
    return rows.mapInPandas(_write_batches, "path string, size_bytes bigint").count()
