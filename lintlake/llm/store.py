"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-sorted by doc_id; every partition writes one shard, a header and then the
raw little-endian ids of its documents.  Shards are written aside in the shared folder and
renamed, so a task that runs again leaves the same file.

The index deals keys by hash to buckets of bounded size.  A bucket is a minimal perfect hash in
levels: at each level a key has one slot; slots hit by one key alone are its place, the other
keys go on to the next level.  The rank of a place among all places is the entry of the key,
which holds a fingerprint, the shard, the offset and the length.  Looking up a key needs a few
array reads, and keys that are not in the index fail their fingerprint.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.files import local_path
from .common import U64, bounded_batches, mix, ship, text_chunks, tidy, written
from .tokens import encoder, with_end

ship(__name__)

MAGIC = b"TOKENIDS"
HEADER = 16
BUCKET_KEYS = 20_000
LEVELS = 48
_GAMMA = 2.0
_RECORDS = pa.schema([("doc_id", pa.int64()), ("occurrence", pa.int64()), ("shard", pa.int32()),
                      ("offset", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("occurrence", pa.int64()), ("shard", pa.int32()),
                   ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.ids"


class _Output:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str):
        self.path, mounted = path, local_path(path)
        if mounted is None:
            from pyarrow import fs

            self.store, self.inner = fs.FileSystem.from_uri(path)
            self.store.create_dir(os.path.dirname(self.inner), recursive=True)
            self.aside = f"{self.inner}.{uuid.uuid4().hex}.part"
            self.handle = self.store.open_output_stream(self.aside)
        else:
            self.store, self.inner = None, mounted
            os.makedirs(os.path.dirname(mounted), exist_ok=True)
            self.aside = f"{mounted}.{uuid.uuid4().hex}.part"
            self.handle = open(self.aside, "wb")

    def done(self) -> None:
        self.handle.close()
        if self.store is None:
            os.replace(self.aside, self.inner)
        else:
            self.store.move(self.aside, self.inner)


def _open_input(path: str):
    mounted = local_path(path)
    if mounted is not None:
        return open(mounted, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _write(folder: str, tokenizer: str, spaced: bool, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, tokens, at, before, times = TaskContext.get().partitionId(), None, None, 0, (), 0
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, cuts in text_chunks(batch):
                if out is None:
                    tokens, out = encoder(tokenizer, spaced), _Output(shard_name(folder, shard))
                    out.handle.write(MAGIC + width.to_bytes(8, "little"))
                found, bounds = with_end(*tokens.encode_flat(data, cuts), end_id)
                if len(found) and int(found.max()) >> (8 * width):
                    raise ValueError(f"id {int(found.max())} does not fit into {width} bytes")
                out.handle.write(found.astype(f"<u{width}").tobytes())
                rows: list[list] = [[] for _ in _RECORDS]
                for doc, length in zip(ids.slice(first, last - first).to_pylist(), np.diff(bounds).tolist()):
                    times = times + 1 if (doc,) == before else 0
                    before = (doc,)
                    for column, value in zip(rows, (doc, times, shard, at, length)):
                        column.append(value)
                    at += length
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _RECORDS)], schema=_RECORDS)
        if out is not None:
            out.done()
    return run


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray, missing: np.ndarray, seed: int) -> np.ndarray:
    h = mix(doc_id.astype(np.int64).view(U64) + U64(seed))
    return mix(h * U64(0xD6E8FEB86659FD93) + occurrence.astype(np.int64).view(U64) * U64(2) + missing.astype(U64))


def _keys(frame: pd.DataFrame, seed: int) -> np.ndarray:
    missing = frame["doc_id"].isna().to_numpy()
    return key_hash(frame["doc_id"].fillna(0).to_numpy(np.int64), frame["occurrence"].to_numpy(np.int64), missing, seed)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit integers."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - 1)
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            slot = cls._slots(left, len(levels), max(8, int(_GAMMA * len(left))))
            hits = np.bincount(slot, minlength=max(8, int(_GAMMA * len(left))))
            levels.append(hits == 1)
            left = left[hits[slot] > 1]
        return cls(levels)

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % U64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1 where no level has a place for it."""
        entry, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            slot = self._slots(keys[left], level, len(bits))
            here = bits[slot]
            entry[left[here]] = self.ranks[level][slot[here]]
            left = left[~here]
        return entry

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        count = int(np.frombuffer(blob, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(blob, "<i8", count, 8).tolist(), 8 + 8 * count, []
        for size in sizes:
            packed = np.frombuffer(blob, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels)


_ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("n_tokens", "<i8")])


def _build(group: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(group, 1)
    table = PerfectHash.build(keys)
    entries = np.zeros(len(group), _ENTRY)
    at = table.find(keys)
    entries["fingerprint"][at] = (_keys(group, 2) >> U64(32)).astype(np.uint32)
    for name in ("shard", "offset", "n_tokens"):
        entries[name][at] = group[name].to_numpy()
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "hash": [table.dump()], "entries": [entries.tobytes()]})


def _find(wanted: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(index) or not len(wanted):
        return wanted.assign(shard=0, offset=0, n_tokens=0).iloc[:0].drop(columns="bucket")
    table = PerfectHash.load(index["hash"].iloc[0])
    entries = np.frombuffer(index["entries"].iloc[0], _ENTRY)
    at = table.find(_keys(wanted, 1))
    got = entries[np.maximum(at, 0)]
    held = (at >= 0) & (got["fingerprint"] == (_keys(wanted, 2) >> U64(32)).astype(np.uint32))
    return wanted.assign(shard=got["shard"], offset=got["offset"], n_tokens=got["n_tokens"])[held].drop(columns="bucket")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle, width = None, None, 0
        for batch in batches:
            shards, offsets, lengths = (batch.column(i).to_pylist() for i in (2, 3, 4))
            sums = []
            for shard, offset, length in zip(shards, offsets, lengths):
                if shard != name:
                    if handle is not None:
                        handle.close()
                    name, handle = shard, _open_input(shard_name(folder, shard))
                    head = handle.read(HEADER)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{shard_name(folder, shard)} is no id shard")
                    width = int.from_bytes(head[8:], "little")
                handle.seek(HEADER + offset * width)
                ids = np.frombuffer(handle.read(length * width), f"<u{width}")
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.record_batch([*batch.columns, pa.array(sums, pa.int64())], schema=_READ)
        if handle is not None:
            handle.close()
    return run


class TokenStore:
    """Shards, the manifest of their first positions, and the index, all below one folder."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.index = spark.read.parquet(f"{self.folder}/index")
        self.manifest = spark.read.parquet(f"{self.folder}/manifest")
        self.buckets = int(spark.read.parquet(f"{self.folder}/format").first()["buckets"])

    @classmethod
    def write(cls, docs: DataFrame, folder: str, tokenizer: str, spaced: bool = True, end_id: int = 0,
              width: int = 2) -> TokenStore:
        """Encodes every row; ``width`` bytes an id must be enough for the vocabulary."""
        spark = docs.sparkSession
        bounded_batches(spark)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # equal ids are ordered by their text, so that runs agree
        ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
            F.col("doc_id").asc_nulls_first(), "text")
        records = written(ordered.mapInArrow(tidy("tokens", _write(folder, tokenizer, spaced, end_id, width)),
                          "doc_id bigint, occurrence bigint, shard int, offset bigint, n_tokens bigint"), "records")
        # one row a shard
        totals = records.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        totals.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
        buckets = max(1, -(-records.count() // BUCKET_KEYS))
        spark.createDataFrame([(buckets, width)], "buckets bigint, width int").coalesce(1).write.parquet(f"{folder}/format")
        records.withColumn("bucket", cls._bucket(buckets)).groupBy("bucket").applyInPandas(
            _build, "bucket bigint, hash binary, entries binary").write.parquet(f"{folder}/index")
        return cls(spark, folder)

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(buckets))

    def find(self, keys: DataFrame) -> DataFrame:
        """shard, offset, n_tokens of each distinct key (doc_id, occurrence from 0) that is stored."""
        wanted = keys.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                             F.col("occurrence").cast("bigint").alias("occurrence")).distinct().withColumn(
            "bucket", self._bucket(self.buckets))
        return wanted.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInPandas(
            _find, "doc_id bigint, occurrence bigint, shard int, offset bigint, n_tokens bigint")

    def read(self, keys: DataFrame) -> DataFrame:
        """doc_id, occurrence, start, n_tokens, ids_crc32 of the stored keys, read from the shards."""
        found = self.find(keys)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        near = found.repartition(parts, "shard").sortWithinPartitions("shard", "offset")
        read = near.mapInArrow(_read(self.folder), "doc_id bigint, occurrence bigint, shard int, offset bigint, "
                               "n_tokens bigint, ids_crc32 bigint")
        return read.join(self.manifest.select("shard", "first_id"), "shard").select(
            "doc_id", "occurrence", (F.col("first_id") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, tokenizer: str, spaced: bool = True, end_id: int = 0, width: int = 2,
                folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files, by keyed access.

    Rows come in the files in ascending doc_id order, those without doc_id first; rows that
    share a doc_id are ordered by text and told apart by their occurrence (0, 1, ...).  Null
    and empty texts hold only the end id.  Further columns are not looked at; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    store = TokenStore.write(docs, folder or scratch_dir(spark, "token-store"), tokenizer, spaced, end_id, width)
    order = Window.partitionBy("doc_id").orderBy("doc_id")
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).withColumn(
        "occurrence", F.row_number().over(order) - 1)
    return store.read(keys).select("doc_id", "start", "n_tokens", "ids_crc32")
