import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import LOWER, odd_rows, table
from lintlake.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5, least=20):
    docs = [(r[0], *features(r[1])) for r in rows]
    own, goal = Counter(b for _, _, f in docs for b in f), Counter(b for t in target for b in features(t)[1])
    s, t = sum(own.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    out, fit = [], []
    for i, w, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        row = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(w) >= least:
            fit.append(row)
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, row in enumerate(fit[:len(fit) * percent // 100]):
        row[4] = n + 1
    return sorted(map(tuple, out), key=repr)


def goal(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")


def many_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["Été", "日本", "x" * 40, "ÀB", "a_b", "9"]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en", "a") for i in range(120)]
    hot = " ".join(rng.choice(words) for _ in range(30))
    return rows + [(300 + i, hot, "en", "b") for i in range(60)] + odd_rows()


@pytest.mark.parametrize("head", [(32768, 65536), (20, 30), (0, 0)])
def test_resampling_equals_plain_version(spark, monkeypatch, head):
    """The result is the same whatever the head holds."""
    monkeypatch.setattr(resampling, "HEAD_WORDS", head[0])
    monkeypatch.setattr(resampling, "HEAD_PAIRS", head[1])
    rows, target = many_rows(), ["w1 w2 w3 w4", None, "", "The quick brown fox", "日本 " * 30]
    got = resampling.resample(table(spark, rows), goal(spark, target), percent=20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, target, 20)


def test_long_texts_in_runs(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 50)
    monkeypatch.setattr(resampling, "RUN_WORDS", 16)
    rows = many_rows()
    got = resampling.resample(table(spark, rows), goal(spark, ["alpha3 beta4 gamma"]), percent=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, ["alpha3 beta4 gamma"], 50)


def test_empty_tables(spark):
    assert resampling.resample(table(spark, []), goal(spark, ["a b"])).count() == 0
    rows = [(1, "a b c"), (2, None), (3, " ".join("abcdefghijklmnopqrstuvwxyz"))]
    got = resampling.resample(table(spark, rows), goal(spark, []), percent=100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, [], 100)


def test_states_continue_each_other():
    rng = random.Random(2)
    left = [rng.randbytes(rng.randint(0, 50)) for _ in range(500)]
    right = [rng.randbytes(rng.randint(0, resampling.HEAD_BYTES)) for _ in left]
    got = resampling.continued(np.array([zlib.crc32(x) for x in left], np.uint32), np.array([len(x) for x in right]),
                               np.array([zlib.crc32(x) for x in right], np.uint32))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]


def test_head_serves_most_features():
    words = [b"alpha", b"beta", b"gamma"]
    head = resampling.Head(words, [b"alpha beta", b"beta gamma"])
    assert (head.pair_key >= 0).sum() == 2
    text = [b"alpha", b"beta", b"gamma", b"unseen", b"alpha", b"y" * 99, b"beta"]
    got, at = head.buckets(text, np.ones(7, bool), np.arange(7))
    want = [zlib.crc32(b" ".join(text[e - n + 1:e + 1])) % 10000 for n in (1, 2, 3) for e in range(n - 1, 7)]
    assert got.tolist() == want and len(at) == len(want)


def test_ranks_are_a_total_order(spark):
    rows = spark.range(1000).withColumnRenamed("id", "v")
    got = resampling.ranked(rows, [F.col("v").desc()]).collect()
    assert sorted((r.place, r.v) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
