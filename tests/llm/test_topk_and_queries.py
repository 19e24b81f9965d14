import math
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF
from helpers import near_components, table
from lintlake.llm import language, packing, topk
from lintlake.llm.queries import ORACLE_SQL, QUERIES
from tools.compare import TABLES, canonical


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None
          and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, "c") for i, v in rows],
                                 "vec_id bigint, embedding array<float>, label int, length double, q string")


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(24)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # one very common vector: ties
    rows += [(1000, None), (1010, [1.0, None]), (1020, [float("nan")] * 24), (None, rows[0][1]), (1030, [float("inf")]),
             (1040, [2.0, 3.0]), (1050, []), (10, rows[10][1]), (20, rows[3][1])]
    rows = [(i, None if v is None else [None if x is None else float(duckdb_float(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_products(embeddings(spark, rows), every=10, k=5).collect())
    assert got == brute(rows, 10, 5)


def duckdb_float(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def test_topk_of_few_rows(spark):
    assert topk.top_products(embeddings(spark, [])).count() == 0
    assert topk.top_products(embeddings(spark, [(50, [1.0, 2.0])])).count() == 0
    got = topk.top_products(embeddings(spark, [(50, [1e6, 2e6]), (51, [3e7, -1.0]), (52, [3e7, -1.0])])).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 51), (2, 52)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_registered():
    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert sorted(int(n[2:n.index("_")]) for n in QUERIES) == list(range(1, 14))


def test_stages_against_plain_versions(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        frames.append(docs.toPandas())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    lang, exact, near, mixed, packed = frames
    good = {r.doc_id for r in language.predict_languages(raw).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert set(lang.doc_id) == good and len(lang) == len(good)
    assert set(exact.doc_id) == set(lang.groupby("text").doc_id.max())
    groups = near_components(list(zip(exact.doc_id, exact.text)), 5)
    assert set(near.doc_id) == set(groups.values())
    assert set(mixed.doc_id) <= set(near.doc_id) and mixed.groupby("doc_id").size().max() <= 2
    words = lambda f: sum(len(t.split()) for t in f.text)
    assert abs(words(mixed) / (1.5 * words(near)) - 1) < 0.1
    assert sorted(packed[packed.piece == 0].doc_id) == sorted(mixed.doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= packing.SEQUENCE_TOKENS


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_place_never_overfills(lengths):
    import numpy as np
    lengths = np.array(sorted(lengths, reverse=True))
    bins, _ = packing.place(lengths, 64, 64, 4096.0, (1.0, 0.0, 0.0), "norm")
    assert max(lengths[bins == b].sum() for b in set(bins.tolist())) <= 64
