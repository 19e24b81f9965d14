"""Centroid clustering with Orchard's search for the nearest centroid.

Every centroid keeps all others in a list sorted by distance.  A vector starts at some
centroid and walks its list: a nearer centroid found on the way becomes the current one and its
list is walked instead, centroids already measured are marked and never measured again, and the
walk stops at the first entry that lies strictly beyond twice the current distance, where the
triangle inequality leaves no room for a nearer centroid or for a tie.  All numbers are integers
and distances are compared squared (four times the square), so nothing is rounded.

Vectors of a batch walk in step.  A task hands on one row of sums for each centroid; only
centroids and their sums, ``clusters`` rows, ever reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship, written

ship(__name__)

#: Vectors that walk together.
STEP_ROWS = 4096
#: Largest size of an integer component: squared distances of any dimension up to 2**30 / 64 fit 64 bits.
LARGEST = 1 << 24

_KEPT = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])


def _integers(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """floor(scale * x) of the vectors with ``dim`` components, none null or non-finite."""
        for batch in batches:
            lists = batch.column(1)
            sized = np.array([n == dim for n in lists.value_lengths().to_pylist()], bool)
            rows = lists.filter(pa.array(sized))
            ids = batch.column(0).filter(pa.array(sized))
            values = rows.flatten().cast(pa.float64()).fill_null(float("nan"))
            values = np.asarray(values.to_numpy(zero_copy_only=False), float).reshape(len(rows), dim)
            kept = np.isfinite(values).all(axis=1)
            scaled = np.floor(scale * values[kept])
            if scaled.size and np.abs(scaled).max() > LARGEST:
                raise ValueError(f"a component times {scale} exceeds {LARGEST}: squared distances would not fit")
            whole = scaled.astype("<i4")
            yield pa.record_batch([ids.filter(pa.array(kept)), pa.array([v.tobytes() for v in whole], pa.binary())],
                                  schema=_KEPT)
    return run


class Orchard:
    """Nearest centroid by walks through sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        k = len(self.centroids)
        self.gaps = np.empty((k, k), np.int64)  # squared distances between centroids
        self.near = np.empty((k, k), np.int32)  # the list of each centroid; it comes first itself
        for i, c in enumerate(self.centroids):
            gap = ((self.centroids - c) ** 2).sum(axis=1)
            gap[i] = -1
            order = np.argsort(gap, kind="stable")
            gap[i] = 0
            self.near[i], self.gaps[i] = order, gap[order]
        self.lengths = np.sqrt((self.centroids.astype(float) ** 2).sum(axis=1))
        self.by_length = np.argsort(self.lengths, kind="stable")
        self.measured = 0

    def _distance(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.measured += len(at)
        apart = rows - self.centroids[at]
        return np.einsum("ij,ij->i", apart, apart)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and squared distance of each vector."""
        parts = [self._walk(np.asarray(vectors[i:i + STEP_ROWS], np.int64))
                 for i in range(0, len(vectors), STEP_ROWS)]
        none = np.zeros(0, np.int64)
        return (np.concatenate([none] + [p[0] for p in parts]), np.concatenate([none] + [p[1] for p in parts]))

    def _walk(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(rows), len(self.centroids)
        # any start is right; one of like length is often near
        length = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        at = self.by_length[np.minimum(np.searchsorted(self.lengths[self.by_length], length), k - 1)].astype(np.int64)
        best = self._distance(rows, at)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), at] = True
        place = np.ones(n, np.int64)  # next entry of the list being walked
        walking = np.arange(n) if k > 1 else np.zeros(0, np.int64)
        while len(walking):
            entry = self.near[at[walking], place[walking]]
            going = self.gaps[at[walking], place[walking]] <= 4 * best[walking]
            walking, entry = walking[going], entry[going]
            new = ~seen[walking, entry]
            fresh, met = walking[new], entry[new].astype(np.int64)
            seen[fresh, met] = True
            place[walking] += 1
            far = self._distance(rows[fresh], met)
            nearer = (far < best[fresh]) | ((far == best[fresh]) & (met < at[fresh]))
            jump = fresh[nearer]
            at[jump], best[jump], place[jump] = met[nearer], far[nearer], 1
            walking = walking[place[walking] < k]
        return at, best


def _matrix(blobs: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), "<i4").reshape(len(blobs), dim).astype(np.int64)


def _sums(centroids: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count and component sums of each centroid's vectors in this task."""
        search, k = Orchard(centroids), len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), dim)
            at, _ = search.assign(rows)
            counts += np.bincount(at, minlength=k)
            order = np.argsort(at, kind="stable")
            held, first = np.unique(at[order], return_index=True)
            if len(held):
                sums[held] += np.add.reduceat(rows[order], first, axis=0)
        held = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(held), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))],
                              ["cluster", "n", "sums"])
    return run


def _assigned(centroids: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for batch in batches:
            at, best = search.assign(_matrix(batch.column(1), dim))
            yield pa.record_batch([batch.column(0), pa.array(at.astype(np.int32)), pa.array(best)],
                                  ["vec_id", "cluster", "distance"])
    return run


def cluster_centroids(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64,
                      seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors with exactly ``dim`` components, none null or non-finite; a component x
    becomes floor(scale * x).  Centroids 0, 1, ... start as the ``clusters`` kept vectors with
    the smallest lowercase-hex sha256 of ``<seed>:<vec_id>`` (fewer if fewer are kept); rows of
    one vec_id are ordered by their components, a null vec_id comes last.  Each round assigns
    every vector to its nearest centroid (ties: smaller number) and replaces centroids that
    have vectors by the componentwise floor of their mean.  ``clusters`` bounds what is kept on
    the driver and in each task.  Repeated rows are rows like any other; further columns are
    not looked at; an empty table gives an empty result.  A component whose integer exceeds
    ``LARGEST`` in size raises, as its squares might not fit 64 bits.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    vectors = written(embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.size("embedding") == dim).mapInArrow(_integers(dim, scale), "vec_id bigint, v binary"), "kept")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.withColumn("name", name).orderBy(F.col("name").asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    centroids = np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in first], np.int64).reshape(len(first), dim)
    component = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
    for _ in range(rounds):
        means = vectors.select("v").mapInArrow(_sums(centroids, dim), "cluster bigint, n bigint, sums array<bigint>")
        centroids = centroids.copy()
        for row in means.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*component).alias("sums")).collect():
            centroids[row["cluster"]] = [s // row["n"] for s in row["sums"]]  # a row for each centroid
    placed = written(vectors.mapInArrow(_assigned(centroids, dim), "vec_id bigint, cluster int, distance bigint"), "placed")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row a centroid
    facts = spark.createDataFrame([(c, d, total, names[c]) for c, d in inertia.items()],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
