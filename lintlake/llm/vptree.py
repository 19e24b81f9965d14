"""Approximate nearest neighbours by inner product: vantage-point trees, one for each shard.

Inner products become angles: with M the largest length, x turns into (x / M, sqrt(1 - |x/M|^2))
and a query into (q / |q|, 0), so the largest product is the smallest angle on one sphere, and
angles obey the triangle inequality.  Vectors are dealt to the nearest of some pivots; a
pivot's region is cut into shards of bounded size by hash, so that a region of any weight is
many shards.  A shard holds a vantage-point tree: every node splits its vectors at the median
angle to a vantage point and knows the least and largest angle of both halves.

A query searches one shard of its own region first, which bounds its k-th angle.  Regions, and
then subtrees, whose least possible angle times ``relax`` is beyond the k-th angle so far are
left out; only the rest is shuffled.  With ``relax`` = 1 nothing is lost and the result is
exact; larger factors read less.  Scores are exact inner products of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, ship, written

ship(__name__)

#: Bytes of vectors in a shard, and vectors in a leaf of its tree.
SHARD_BYTES, LEAF = 1 << 21, 128
#: Queries handled together, and a bounded sample, the first by hash, that pivots are taken from.
QUERY_ROWS, SAMPLE = 256, 4096
#: Pivots at most: one row of bounds for each is all that the driver and tasks hold of the index.
PIVOTS = 128
#: Rounding of angles, far above what arccos and the products lose.
SLACK = 1e-6
#: Factor unless another is asked for; README has measured recalls of others.
RELAX = 1.0

_VECTORS = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("length", pa.float64()), ("v", pa.binary())])
_SHARD = "region int, part int, kind int, block bigint, ids binary, vs binary, more binary"
_FOUND = "block bigint, place int, query_id bigint, vec_id bigint, score double"
_F8, _I8 = "<f8", "<i8"


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with an id and a vector that is finite in every component and not zero."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
        values = lists.flatten().cast(pa.float64()).fill_null(float("nan"))
        values = np.asarray(values.to_numpy(zero_copy_only=False), float)
        of = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore", invalid="ignore"):
            largest = np.zeros(len(sizes))
            np.maximum.at(largest, of, np.abs(np.nan_to_num(values, posinf=0.0, neginf=0.0)))
            scaled = values / np.where(largest > 0, largest, 1)[of]
            length = largest * np.sqrt(np.bincount(of, scaled * scaled, len(sizes)))
        kept = np.flatnonzero((np.bincount(of, ~np.isfinite(values), len(sizes)) == 0) & (largest > 0)
                              & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        yield pa.record_batch([
            pa.array(ids[kept]), pa.array(sizes[kept].astype(np.int32)), pa.array(length[kept]),
            pa.array([values[ends[i] - sizes[i]:ends[i]].astype(_F8).tobytes() for i in kept], pa.binary())],
            schema=_VECTORS)


def _padded(blobs: list, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which change no product."""
    out = np.zeros((len(blobs), dim))
    for row, blob in zip(out, blobs):
        row[:len(blob) // 8] = np.frombuffer(blob, _F8)
    return out


def _raised(vs: np.ndarray, longest: float) -> np.ndarray:
    """Candidates on the unit sphere of one more dimension."""
    short = vs / longest
    rest = np.sqrt(np.maximum(0.0, 1 - (short * short).sum(axis=1)))
    return np.concatenate([short, rest[:, None]], axis=1)


def _pointed(qs: np.ndarray) -> np.ndarray:
    """Queries on the same sphere."""
    short = qs / np.abs(qs).max(axis=1, keepdims=True)
    return np.concatenate([short / np.sqrt((short * short).sum(axis=1))[:, None], np.zeros((len(qs), 1))], axis=1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def products(qs: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added from the first component to the last."""
    total = np.zeros(len(qs))
    for j in range(qs.shape[1]):
        total += qs[:, j] * vs[:, j]
    return total


def spread_out(points: np.ndarray, n: int) -> list[int]:
    """Up to ``n`` distinct points, each the farthest from those before it, so that every clump has one."""
    chosen, nearest = [0], points @ points[0]
    while len(chosen) < n and nearest.min() < 1 - SLACK * SLACK:
        chosen.append(int(nearest.argmin()))
        np.maximum(nearest, points @ points[chosen[-1]], out=nearest)
    return chosen


# --- the tree of a shard ---------------------------------------------------------

def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points by leaf, leaf borders, and all bounds.

    A bound is (vantage point, first leaf, last leaf + 1, least angle, largest angle): the
    points of these leaves lie between the two angles of that vantage point.
    """
    order, borders, bounds = [], [0], []

    def split(rows: np.ndarray) -> None:
        if len(rows) <= LEAF:
            order.append(rows)
            borders.append(borders[-1] + len(rows))
            return
        # the point farthest from some point sees its node from the rim
        vantage = rows[int(np.argmin(points[rows] @ points[rows[0]]))]
        angle = _angles(points[rows], points[vantage:vantage + 1])[:, 0]
        near_first = np.argsort(angle, kind="stable")
        half = len(rows) // 2
        for side in (near_first[:half], near_first[half:]):
            leaf = len(borders) - 1
            split(rows[side])
            bounds.append((vantage, leaf, len(borders) - 1, angle[side].min(), angle[side].max()))

    split(np.arange(len(points)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none] + order), np.array(borders), np.array(bounds).reshape(-1, 5)


class Shard:
    """Vectors of a shard in leaf order, with the bounds of its tree."""

    def __init__(self, ids: bytes, vs: bytes, more: bytes, dim: int, longest: float):
        self.ids = np.frombuffer(ids, _I8)
        self.vs = np.frombuffer(vs, _F8).reshape(len(self.ids), dim)
        n = int(np.frombuffer(more, _I8, 1)[0])
        self.borders = np.frombuffer(more, _I8, n, 8)
        self.bounds = np.frombuffer(more, _F8, -1, 8 + 8 * n).reshape(-1, 5)
        self.points = _raised(self.vs, longest)
        self.vantages, self.of = np.unique(self.bounds[:, 0].astype(np.int64), return_inverse=True)

    @staticmethod
    def pack(ids: list, vs: np.ndarray, longest: float) -> tuple[bytes, bytes, bytes]:
        order, borders, bounds = build_tree(_raised(vs, longest))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))  # where a vantage point stands now
        if len(bounds):
            bounds[:, 0] = at[bounds[:, 0].astype(np.int64)]
        more = np.array([len(borders)], _I8).tobytes() + borders.astype(_I8).tobytes() + bounds.astype(_F8).tobytes()
        return np.array(ids, _I8)[order].tobytes(), vs[order].astype(_F8).tobytes(), more

    def least(self, points: np.ndarray) -> np.ndarray:
        """Least angle that each leaf can hold for each query, by all vantage points above it."""
        least = np.zeros((len(points), len(self.borders) - 1))
        if len(self.bounds):
            angle = _angles(points, self.points[self.vantages])
            for bound, seen in zip(self.bounds, self.of.tolist()):
                low = np.maximum(bound[3] - angle[:, seen], angle[:, seen] - bound[4])
                leaves = slice(int(bound[1]), int(bound[2]))
                np.maximum(least[:, leaves], low[:, None], out=least[:, leaves])
        return least


class Search:
    """The k best of each query of a block so far."""

    def __init__(self, query_ids: np.ndarray, qs: np.ndarray, worst: np.ndarray, k: int, longest: float, relax: float):
        self.query_ids, self.qs, self.worst, self.k, self.relax = query_ids, qs, worst.copy(), k, relax
        self.points, self.longest = _pointed(qs), longest
        self.scale = np.sqrt((qs * qs).sum(axis=1)) * longest  # score = scale * cos(angle)
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in query_ids]
        self.measured = 0

    def open(self, least: np.ndarray) -> np.ndarray:
        """Whether something as near as the k-th so far may lie at this angle or beyond it."""
        return self.relax * np.maximum(least - SLACK, 0.0) <= self.angle()

    def angle(self) -> np.ndarray:
        return np.where(np.isneginf(self.worst), np.pi, np.arccos(np.clip(self.worst / self.scale, -1, 1))) + SLACK

    def meet(self, shard: Shard) -> None:
        if not len(shard.ids):
            return
        least = shard.least(self.points)
        first = least.argmin(axis=1)
        for leaf in np.unique(first).tolist():  # each query's most promising leaf
            self._leaf(shard, leaf, np.flatnonzero(first == leaf))
        for leaf in range(least.shape[1]):
            self._leaf(shard, leaf, np.flatnonzero((first != leaf) & self.open(least[:, leaf])))

    def _leaf(self, shard: Shard, leaf: int, rows: np.ndarray) -> None:
        a, b = shard.borders[leaf], shard.borders[leaf + 1]
        if not len(rows) or a == b:
            return
        self.measured += len(rows) * int(b - a)
        about = self.points[rows] @ shard.points[a:b].T * self.scale[rows, None]
        slack = 1e-9 * self.scale[rows, None]
        near = (about >= self.worst[rows, None] - slack) & (self.query_ids[rows, None] != shard.ids[a:b])
        q, x = np.nonzero(near)
        scores = products(self.qs[rows[q]], shard.vs[a + x])
        for i, lo, hi in zip(rows.tolist(), *(np.searchsorted(q, np.arange(len(rows)), s).tolist() for s in ("left", "right"))):
            if lo < hi:
                self._add(i, scores[lo:hi], shard.ids[a + x[lo:hi]])

    def _add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.best[i] = scores[order], ids[order]
        if len(order) == self.k:
            self.worst[i] = max(self.worst[i], scores[order[-1]])


# --- Spark stages ------------------------------------------------------------------

def _dealt(pivots: np.ndarray, dim: int, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Region (nearest pivot) of each vector and its angle to the pivot."""
        points = _raised(pivots, longest)
        for batch in batches:
            angle = _angles(_raised(_padded(batch.column(1).to_pylist(), dim), longest), points)
            region = angle.argmin(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(region.astype(np.int32)),
                                   pa.array(angle[np.arange(len(region)), region])],
                                  ["vec_id", "v", "region", "angle"])
    return run


def _trees(dim: int, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row, a packed shard, for each run of rows of one (region, part)."""
        name, ids, vs = None, [], []

        def packed():
            blobs = Shard.pack(ids, _padded(vs, dim), longest)
            return pa.record_batch([pa.array([name[0]], pa.int32()), pa.array([name[1]], pa.int32()), pa.array([0], pa.int32()),
                                    pa.array([-1], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)],
                                   ["region", "part", "kind", "block", "ids", "vs", "more"])

        for batch in batches:
            for region, part, vec_id, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (region, part) != name:
                    if ids:
                        yield packed()
                    name, ids, vs = (region, part), [], []
                ids.append(vec_id)
                vs.append(v)
        if ids:
            yield packed()
    return run


def _query_blocks(pivots: np.ndarray, parts: np.ndarray, dim: int, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries of one region, each meant for one shard of it first."""
        points, waiting, block = _raised(pivots, longest), {}, TaskContext.get().partitionId() << 32

        def made(region):
            nonlocal block
            rows, waiting[region] = waiting[region], []
            part, no = block % int(parts[region]), block
            block += 1
            return pa.record_batch([pa.array([region], pa.int32()), pa.array([part], pa.int32()), pa.array([1], pa.int32()),
                                    pa.array([no]), pa.array([np.array([i for i, _ in rows], _I8).tobytes()], pa.binary()),
                                    pa.array([_padded([v for _, v in rows], dim).astype(_F8).tobytes()], pa.binary()),
                                    pa.array([np.full(len(rows), -np.inf).tobytes()], pa.binary())],
                                   ["region", "part", "kind", "block", "ids", "vs", "more"])

        for batch in batches:
            ids, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            angle = _angles(_pointed(_padded(vs, dim)), points) if ids else np.zeros((0, 1))
            for row, region in enumerate(angle.argmin(axis=1).tolist()):
                waiting.setdefault(region, []).append((ids[row], vs[row]))
                if len(waiting[region]) == QUERY_ROWS:
                    yield made(region)
        for region in [r for r, rows in waiting.items() if rows]:
            yield made(region)
    return run


def _searched(dim: int, k: int, longest: float, relax: float, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams a shard and then the query blocks sent to it.

        The first round returns its blocks with k-th scores, places and what was found; later
        rounds return only neighbours that can still count.
        """
        shard, held = None, None
        for batch in batches:
            region, part, kind, block, ids, vs, more, place = (batch.column(i) for i in range(8))
            for row in range(len(batch)):
                name = region[row].as_py(), part[row].as_py()
                if kind[row].as_py() == 0:
                    shard, held = Shard(ids[row].as_py(), vs[row].as_py(), more[row].as_py(), dim, longest), name
                    continue
                query_ids = np.frombuffer(ids[row].as_py(), _I8)
                qs = np.frombuffer(vs[row].as_py(), _F8).reshape(len(query_ids), dim)
                places = np.arange(len(query_ids), dtype=np.int32) if first else np.frombuffer(place[row].as_py(), "<i4")
                search = Search(query_ids, qs, np.frombuffer(more[row].as_py(), _F8), k, longest, relax)
                if held == name:
                    search.meet(shard)
                counts = [len(s) for s, _ in search.best]
                found = (np.concatenate([np.zeros(0)] + [s for s, _ in search.best]),
                         np.concatenate([np.zeros(0, np.int64)] + [i for _, i in search.best]))
                if first:
                    yield pa.record_batch([
                        batch.column(i).slice(row, 1) for i in (0, 1, 3, 4, 5)] + [
                        pa.array([search.worst.astype(_F8).tobytes()], pa.binary()),
                        pa.array([np.array(counts, "<i4").tobytes()], pa.binary()),
                        pa.array([found[1].astype(_I8).tobytes()], pa.binary()),
                        pa.array([found[0].astype(_F8).tobytes()], pa.binary())],
                        ["region", "part", "block", "ids", "vs", "more", "counts", "found", "scores"])
                elif sum(counts):
                    yield pa.record_batch([
                        pa.array(np.full(sum(counts), block[row].as_py(), np.int64)),
                        pa.array(np.repeat(places, counts)), pa.array(np.repeat(query_ids, counts)),
                        pa.array(found[1]), pa.array(found[0])], ["block", "place", "query_id", "vec_id", "score"])
    return run


def _first_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids, counts, found, scores in zip(*(c.to_pylist() for c in batch.columns)):
            counts, ids = np.frombuffer(counts, "<i4"), np.frombuffer(ids, _I8)
            yield pa.record_batch([
                pa.array(np.full(int(counts.sum()), block, np.int64)),
                pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), counts)), pa.array(np.repeat(ids, counts)),
                pa.array(np.frombuffer(found, _I8)), pa.array(np.frombuffer(scores, _F8))],
                ["block", "place", "query_id", "vec_id", "score"])


def _routed(pivots: np.ndarray, low: np.ndarray, high: np.ndarray, dim: int, k: int, longest: float, relax: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block and region that may still hold a neighbour of some of its queries."""
        points = _raised(pivots, longest)
        for batch in batches:
            for home, home_part, block, ids, vs, more in zip(*(c.to_pylist() for c in batch.columns)):
                query_ids, worst = np.frombuffer(ids, _I8), np.frombuffer(more, _F8)
                search = Search(query_ids, np.frombuffer(vs, _F8).reshape(-1, dim), worst, k, longest, relax)
                angle = _angles(search.points, points)
                least = np.maximum(np.maximum(low - angle, angle - high), 0)
                for region in range(len(pivots)):
                    rows = np.flatnonzero(search.open(least[:, region]))
                    if len(rows):
                        yield pa.record_batch([
                            pa.array([region], pa.int32()), pa.array([home_part if region == home else -1], pa.int32()),
                            pa.array([block]), pa.array([query_ids[rows].tobytes()], pa.binary()),
                            pa.array([search.qs[rows].tobytes()], pa.binary()),
                            pa.array([worst[rows].tobytes()], pa.binary()),
                            pa.array([rows.astype("<i4").tobytes()], pa.binary())],
                            ["region", "searched", "block", "ids", "vs", "more", "place"])
    return run


class VantageIndex:
    """Shards of ``vectors`` (vec_id, length, v) with their trees, as a written table."""

    def __init__(self, vectors: DataFrame, dim: int, longest: float, n: int):
        self.spark: SparkSession = vectors.sparkSession
        self.dim, self.longest = dim, longest
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shard_rows = max(LEAF, SHARD_BYTES // (8 * dim))
        wanted = max(1, min(PIVOTS, n // shard_rows))
        sample = vectors.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()
        sampled = _padded([bytes(r["v"]) for r in sample], dim)
        self.pivots = sampled[spread_out(_raised(sampled, longest), wanted)]
        dealt = written(vectors.select("vec_id", "v").mapInArrow(
            _dealt(self.pivots, dim, longest), "vec_id bigint, v binary, region int, angle double"), "dealt")
        regions = len(self.pivots)
        self.low, self.high, self.parts = np.full(regions, np.inf), np.full(regions, -np.inf), np.ones(regions, np.int64)
        for r in dealt.groupBy("region").agg(F.count("*").alias("n"), F.min("angle").alias("low"),
                                             F.max("angle").alias("high")).collect():  # a row for each pivot
            self.low[r["region"]], self.high[r["region"]] = r["low"], r["high"]
            self.parts[r["region"]] = -(-r["n"] // shard_rows)
        sizes = self.spark.createDataFrame([(i, int(p)) for i, p in enumerate(self.parts)], "region int, parts int")
        # the running number spreads rows that are equal throughout
        named = dealt.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(sizes), "region").withColumn(
            "part", F.pmod(F.xxhash64("vec_id", "row"), F.col("parts")).cast("int"))
        self.shards = written(named.select("region", "part", "vec_id", "v").repartition(self.tasks, "region", "part")
                              .sortWithinPartitions("region", "part", "vec_id", "v").mapInArrow(
            _trees(dim, longest), _SHARD), "shards")

    def _meet(self, blocks: DataFrame, k: int, relax: float, first: bool, schema: str) -> DataFrame:
        both = self.shards.withColumn("place", F.lit(None).cast("binary")).unionByName(blocks)
        lined = both.repartition(self.tasks, "region", "part").sortWithinPartitions("region", "part", "kind", "block")
        return lined.select("region", "part", "kind", "block", "ids", "vs", "more", "place").mapInArrow(
            _searched(self.dim, k, self.longest, relax, first), schema)

    def search(self, queries: DataFrame, k: int, relax: float) -> DataFrame:
        """block, place (which name a query), query_id, vec_id, score: the k nearest found of each."""
        dim, longest = self.dim, self.longest
        queries = written(queries.select("vec_id", "v"), "queries")
        # as many tasks as let every region fill its blocks
        tasks = max(1, min(self.tasks, queries.count() // (QUERY_ROWS * len(self.pivots))))
        blocks = written(queries.repartition(tasks, "vec_id").sortWithinPartitions("vec_id", "v").mapInArrow(_query_blocks(self.pivots, self.parts, dim, longest), _SHARD), "blocks")
        begun = written(self._meet(blocks.withColumn("place", F.lit(None).cast("binary")), k, relax, True,
                                   "region int, part int, block bigint, ids binary, vs binary, more binary, "
                                   "counts binary, found binary, scores binary"), "begun")
        routed = begun.select("region", "part", "block", "ids", "vs", "more").mapInArrow(
            _routed(self.pivots, self.low, self.high, dim, k, longest, relax),
            "region int, searched int, block bigint, ids binary, vs binary, more binary, place binary")
        sizes = self.spark.createDataFrame([(i, int(p)) for i, p in enumerate(self.parts)], "region int, parts int")
        sent = routed.join(F.broadcast(sizes), "region").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> searched").select(
            "region", "part", F.lit(1).alias("kind"), "block", "ids", "vs", "more", "place")
        found = self._meet(sent, k, relax, False, _FOUND).unionByName(
            begun.select("block", "ids", "counts", "found", "scores").mapInArrow(_first_found, _FOUND))
        rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_products(embeddings: DataFrame, every: int = 20, k: int = 20, relax: float = RELAX) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, by inner product.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of
    another vec_id.  Ties go to the smaller vec_id.  Rows whose vec_id or vector is null, whose
    vector is empty, zero or holds a null or non-finite component, take no part.  Vectors of
    different dimension are multiplied over the components both have.  Rows that repeat a
    vec_id with another vector are queries and candidates of their own; fully repeated rows are
    one query and several candidates.  Lengths must be finite.  Further columns are not looked
    at; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    vectors = written(embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .mapInArrow(_valid, "vec_id bigint, dim int, length double, v binary"), "vectors")
    size = vectors.agg(F.max("dim"), F.max("length"), F.count("*")).first()
    if not size[2]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = VantageIndex(vectors, size[0], size[1] * (1 + 1e-12), size[2])
    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    return index.search(queries, k, relax).select("query_id", "rank", "vec_id", "score")
