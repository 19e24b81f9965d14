import hashlib
import math
import random
import struct

import numpy as np
import pytest

from lintlake.llm import centroids, vptree


def single(x):
    return None if x is None else struct.unpack("f", struct.pack("f", x))[0]


def frame(spark, rows):
    """Embeddings with further columns whose names clash with those that operators make."""
    rows = [(i, None if v is None else [single(x) for x in v], 7, 2, "p") for i, v in rows]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cluster int, distance int, part string")


def lloyd(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * single(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=name)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [min((square(v, c), n) for n, c in enumerate(cents)) for _, v in kept]
        if turn < rounds:
            for n in range(len(cents)):
                own = [v for (_, v), (_, at) in zip(kept, near) if at == n]
                if own:
                    cents[n] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in near)
    return sorted(((i, n, d, sum(e for e, m in near if m == n), total,
                    hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, near)), key=repr)


def clumps(n, dim, seed):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [rng.gauss(m, 0.2) for m in rng.choice(middles)]) for i in range(n)]


def test_clusters_equal_plain_rounds(spark):
    rows = clumps(400, 8, 1)
    rows += [(400 + i, rows[3][1]) for i in range(200)]  # a third of all rows is one vector
    rows += [(1000, None), (1001, []), (1002, [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [float("nan")] * 8),
             (1005, [float("inf")] * 8), (None, rows[0][1]), (5, rows[9][1]), (6, rows[6][1])]
    got = centroids.cluster_centroids(frame(spark, rows), clusters=16, rounds=3, dim=8, scale=64)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows, 16, 3, 8, 64)


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 4)], [(1, None)], [(1, [0.0] * 4), (2, [0.0] * 4)]])
def test_clusters_of_few_rows(spark, rows):
    got = centroids.cluster_centroids(frame(spark, rows), clusters=16, rounds=2, dim=4)
    assert sorted(tuple(r) for r in got.collect()) == lloyd(rows, 16, 2, 4, 64)


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster_centroids(frame(spark, [(1, [1e30])]), dim=1).collect()


def test_orchard_measures_less_and_keeps_ties():
    rng = np.random.default_rng(5)
    cents = np.concatenate([rng.integers(-400, 400, (60, 6)), [[0] * 6, [2] * 6, [2] * 6]])
    rows = np.concatenate([cents[rng.integers(0, 60, 3000)] + rng.integers(-9, 9, (3000, 6)), [[1] * 6, [2] * 6]])
    search = centroids.Orchard(cents)
    at, best = search.assign(rows)
    every = ((rows[:, None] - cents) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (at == every.argmin(axis=1)).all()
    assert search.measured < every.size / 2  # the walk stops early


def brute(rows, every, k):
    ok = [(i, tuple(map(single, v))) for i, v in rows if i is not None and v
          and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in sorted(set(r for r in ok if r[0] % every == 0)):
        found = []
        for i, w in ok:
            if i != q:
                score = 0.0
                for a, b in zip(v, w):
                    score += a * b
                found.append((-score, i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def odd_vectors():
    rows = [(i, [x * (1 + i % 3) for x in v]) for i, v in clumps(500, 12, 2)]
    rows += [(500 + i, rows[20][1]) for i in range(250)]  # one very common vector: ties
    return rows + [(1000, None), (1020, []), (1040, [0.0] * 12), (1060, [None] * 12), (1080, [float("nan")] * 12),
                   (1100, [float("-inf")] * 12), (None, rows[1][1]), (1120, [1.0, -2.0]), (20, rows[20][1]),
                   (40, rows[3][1]), (60, rows[60][1])]


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_BYTES", 96 * 64)
    monkeypatch.setattr(vptree, "QUERY_ROWS", 5)
    rows = odd_vectors()
    got = sorted(tuple(r) for r in vptree.nearest_products(frame(spark, rows), every=20, k=7).collect())
    assert got == brute(rows, 20, 7)


def test_recall_of_relaxed_factors(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_BYTES", 96 * 64)
    rows = [(i, v) for i, v in clumps(1500, 12, 3)]
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 10)}
    for relax, least in ((1.0, 1.0), (1.1, 0.9)):
        got = {(r.query_id, r.vec_id) for r in vptree.nearest_products(frame(spark, rows), every=20, k=10, relax=relax).collect()}
        assert len(got & want) >= least * len(want)


def test_larger_factors_read_less():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16)) * 3
    vs = middles[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.3
    longest = np.sqrt((vs * vs).sum(axis=1)).max()
    shard = vptree.Shard(*vptree.Shard.pack(list(range(4000)), vs, longest), 16, longest)
    measured = []
    for relax in (1.0, 2.0, 4.0):
        search = vptree.Search(np.arange(50), vs[:50], np.full(50, -np.inf), 10, longest, relax)
        search.meet(shard)
        measured.append(search.measured)
        exact = np.sort(np.where(np.eye(50, 4000, dtype=bool), -np.inf, vs[:50] @ vs.T), axis=1)[:, -10:]
        hit = np.mean([np.isin(np.round(b[0], 6), np.round(e, 6)).mean() for b, e in zip(search.best, exact)])
        assert hit == 1.0 or relax > 1
    assert measured[0] < 50 * 4000 and measured == sorted(measured, reverse=True) and measured[2] < measured[0]


def test_only_regions_in_reach_are_read(spark, monkeypatch):
    """Blocks of queries are sent only to regions that the bounds leave open."""
    monkeypatch.setattr(vptree, "SHARD_BYTES", 96 * 64)
    sent = []
    meet = vptree.VantageIndex._meet

    def watched(self, blocks, k, relax, first, schema):
        sent.append((blocks.count(), self.shards.count()))
        return meet(self, blocks, k, relax, first, schema)

    monkeypatch.setattr(vptree.VantageIndex, "_meet", watched)
    rng = random.Random(9)
    middles = [[9.0 if j == m else 0.0 for j in range(12)] for m in range(12)]
    rows = [(i, [rng.gauss(x, 0.05) for x in middles[i % 12]]) for i in range(1200)]
    got = sorted(tuple(r) for r in vptree.nearest_products(frame(spark, rows), every=20, k=5).collect())
    assert got == brute(rows, 20, 5)
    (blocks, shards), (read, _) = sent
    assert blocks >= 12 and shards >= 12 and read < blocks * shards / 10


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(20, [1.0]), (21, [3.0]), (40, [-2.0])]])
def test_neighbours_of_few_rows(spark, rows):
    got = sorted(tuple(r) for r in vptree.nearest_products(frame(spark, rows), every=20, k=20).collect())
    assert got == brute(rows, 20, 20)
