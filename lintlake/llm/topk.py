"""Exact top-k inner products over norm-sorted blocks.

Vectors are range-sorted by descending length and packed into blocks.  A group of blocks meets
one block of queries in one task, longest vectors first, one pair of blocks in memory at a
time.  A block is left out for a query whose length times the block's largest length is below
its k-th score so far.  Otherwise vectors are rotated by the singular vectors of a sample:
the first rotated components give a partial sum, Cauchy-Schwarz bounds the rest, and only pairs
whose bound reaches the k-th score get their exact integer product.  The rotation and the
sample only decide how much is pruned, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, ship, written

ship(__name__)

BLOCK = 2048
QUERY_BLOCK = 256
#: Blocks that follow each other in one task.
RUN_BLOCKS = 16
#: Vectors that the rotation is fitted on.
SAMPLE = 4_000
#: Rotated components of the partial sum.
HEAD = 16

_VECTORS = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("largest", pa.int64()),
                      ("length", pa.float64()), ("v", pa.binary())])
_BLOCKS = pa.schema([("block", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("vs", pa.binary())])
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 * x) of every component; rows with null or non-finite parts are left out."""
    for batch in batches:
        lists = batch.column(1)
        rows = lists.flatten()  # skips null lists
        sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
        values = np.asarray(rows.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64)
        ends = np.cumsum(sizes)
        bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(values)], minlength=len(sizes)) > 0
        bad |= ~lists.is_valid().to_numpy(zero_copy_only=False) | ~batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ints = np.floor(256 * np.nan_to_num(values, posinf=0, neginf=0)).astype("<i8")
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(~bad)
        parts = [ints[ends[i] - sizes[i]:ends[i]] for i in kept]
        yield pa.record_batch([
            pa.array(ids[kept]), pa.array(sizes[kept].astype(np.int32)),
            pa.array([int(np.abs(p).max(initial=0)) for p in parts], pa.int64()),
            pa.array([float(np.sqrt((p.astype(float) ** 2).sum())) for p in parts], pa.float64()),
            pa.array([p.tobytes() for p in parts], pa.binary())], schema=_VECTORS)


def _padded(blobs: list[bytes], dim: int) -> np.ndarray:
    """Integer matrix; shorter vectors end in zeros, which change no product."""
    out = np.zeros((len(blobs), dim), "<i8")
    for row, blob in zip(out, blobs):
        row[:len(blob) // 8] = np.frombuffer(blob, "<i8")
    return out


def _blocks(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, blobs, no = [], [], [], TaskContext.get().partitionId() << 32

        def block():
            return pa.record_batch([
                pa.array([no], pa.int64()), pa.array([max(lengths[:BLOCK])], pa.float64()),
                pa.array([np.array(ids[:BLOCK], "<i8").tobytes()], pa.binary()),
                pa.array([_padded(blobs[:BLOCK], dim).tobytes()], pa.binary())], schema=_BLOCKS)

        for batch in batches:
            ids += batch.column(0).to_pylist()
            lengths += batch.column(1).to_pylist()
            blobs += batch.column(2).to_pylist()
            while len(ids) >= BLOCK:
                yield block()
                ids, lengths, blobs, no = ids[BLOCK:], lengths[BLOCK:], blobs[BLOCK:], no + 1
        if ids:
            yield block()
    return run


def _query_block(dim: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "q": [group["q"].iloc[0]], "queries": [group["query"].to_numpy("<i8").tobytes()],
            "query_ids": [group["vec_id"].to_numpy("<i8").tobytes()],
            "query_vs": [_padded(list(group["v"]), dim).tobytes()]})
    return run


class _Best:
    """The k best of each query of a block so far."""

    def __init__(self, queries: bytes, query_ids: bytes, vs: bytes, dim: int, k: int, rotation: np.ndarray, exact: bool):
        self.keys, self.ids = np.frombuffer(queries, "<i8"), np.frombuffer(query_ids, "<i8")
        self.vs = np.frombuffer(vs, "<i8").reshape(len(self.ids), dim)
        self.rotation, self.exact, self.k = rotation, exact, k
        turned = self.vs @ rotation
        self.head, self.rest = turned[:, :HEAD], np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))
        self.length = np.sqrt((self.vs.astype(float) ** 2).sum(axis=1))
        self.worst = np.full(len(self.ids), -np.inf)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]

    def meet(self, longest: float, ids: bytes, vs: bytes) -> None:
        slack = 1 + 1e-9 * self.length * longest
        open_ = np.flatnonzero(self.length * longest + slack >= self.worst)
        if not len(open_):
            return
        ids = np.frombuffer(ids, "<i8")
        vs = np.frombuffer(vs, "<i8").reshape(len(ids), -1)
        turned = vs @ self.rotation
        rest = np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))
        bound = self.head[open_] @ turned[:, :HEAD].T + self.rest[open_, None] * rest + slack[open_, None]
        wanted = (bound >= self.worst[open_, None]) & (self.ids[open_, None] != ids)
        near = np.flatnonzero(wanted.any(axis=0))
        if self.exact:
            scores = np.rint(self.vs[open_].astype(float) @ vs[near].T.astype(float)).astype(np.int64)
        else:
            scores = self.vs[open_] @ vs[near].T
        for row, q in enumerate(open_.tolist()):
            hit = wanted[row, near] & (scores[row] >= self.worst[q])
            if hit.any():
                self._add(q, scores[row, hit], ids[near[hit]])

    def _add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:  # ties with the k-th stay until ids decide
            held = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[held], ids[held]
        scores, ids = np.concatenate([self.best[q][0], scores]), np.concatenate([self.best[q][1], ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.best[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.worst[q] = scores[order[-1]]

    def rows(self) -> pa.RecordBatch:
        counts = [len(s) for s, _ in self.best]
        none = [np.zeros(0, np.int64)]
        return pa.record_batch([
            pa.array(np.repeat(self.keys, counts)), pa.array(np.repeat(self.ids, counts)),
            pa.array(np.concatenate(none + [i for _, i in self.best])),
            pa.array(np.concatenate(none + [s for s, _ in self.best]))], schema=_FOUND)


def _search(dim: int, k: int, rotation: np.ndarray, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best = None, None
        for batch in batches:
            for row in range(len(batch)):
                q, part, longest, ids, vs, queries, query_ids, query_vs = (c[row].as_py() for c in batch.columns)
                if (q, part) != name:
                    if best is not None:
                        yield best.rows()
                    name, best = (q, part), _Best(queries, query_ids, query_vs, dim, k, rotation, exact)
                best.meet(longest, ids, vs)
        if best is not None:
            yield best.rows()
    return run


def _rotation(vectors: DataFrame, dim: int, sample: int) -> np.ndarray:
    """Right singular vectors of a bounded sample, chosen by hash."""
    rows = vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(sample).collect()
    if not rows or not dim:
        return np.eye(dim)
    # the right singular vectors, by the small square matrix that has them as eigenvectors
    sampled = _padded([bytes(r["v"]) for r in rows], dim).astype(float)
    return np.linalg.eigh(sampled.T @ sampled)[1][:, ::-1]


def top_products(embeddings: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer products of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of
    another vec_id.  Ties go to the smaller vec_id.  Rows whose vec_id or vector is null, or
    whose vector holds a null or non-finite component, take no part.  Vectors of different
    dimension are multiplied over the components both have; an empty vector gives 0.  Rows
    that repeat a vec_id with another vector are queries and candidates of their own; fully
    repeated rows are one query and several candidates.  Products must fit 64 bits.  Further
    columns are not looked at; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    vectors = written(embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .mapInArrow(_integers, "vec_id bigint, dim int, largest bigint, length double, v binary"), "vectors")
    queries = vectors.where(F.col("vec_id") % every == 0).select(
        F.xxhash64("vec_id", "v").alias("query"), "vec_id", "v").distinct()
    size = vectors.agg(F.max("dim"), F.max("largest"), F.count("*")).first()
    dim, largest, n = size[0] or 0, size[1] or 0, size[2]
    exact = largest * largest * max(dim, 1) < 1 << 53  # then floating-point products are exact
    rotation = _rotation(vectors, dim, sample)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK)))
    longest_first = [F.col("length").desc(), F.col("vec_id")]
    blocks = written(vectors.select("vec_id", "length", "v").repartitionByRange(parts, *longest_first)
                     .sortWithinPartitions(*longest_first).mapInArrow(
        _blocks(dim), "block bigint, longest double, ids binary, vs binary"), "blocks")
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = written(queries.withColumn("q", F.pmod("query", F.lit(query_blocks))).groupBy("q").applyInPandas(
        _query_block(dim), "q bigint, queries binary, query_ids binary, query_vs binary"), "queries")
    runs = max(1, -(-n // (BLOCK * RUN_BLOCKS)))
    # every block of candidates meets every block of queries: a stated query set, in blocks
    met = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(runs))).withColumn(
        "q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint")))).join(packed, "q")
    lined = met.repartition(max(1, query_blocks * runs), "q", "part").sortWithinPartitions(
        "q", "part", F.col("longest").desc(), "block")
    found = lined.select("q", "part", "longest", "ids", "vs", "queries", "query_ids", "query_vs").mapInArrow(
        _search(dim, k, rotation, exact), "query bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
