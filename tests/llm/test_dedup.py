import hashlib
import random

import numpy as np
import pytest

from helpers import near_components, odd_rows, shingles, table
from lintlake.llm import common, exact, minhash
from lintlake.llm.components import components
from lintlake.session import scratch_dir


def alternating(n=10):
    """Two words of 2**n letters whose polynomial sums modulo a power of two are equal for every base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
    return word, word.translate(str.maketrans("ab", "ba"))


def near_corpus(n_groups=6, size=14, seed=1):
    """Groups of texts with some words changed, so that similarities lie around the threshold."""
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(90)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10 ** 6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = near_corpus()
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, rows), width).collect()}
    want = near_components(rows, width)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    assert all(got[i].n_shingles == len(shingles(t, width)) for i, t in rows)


def test_last_round_alone_finds_all_links(spark, monkeypatch):
    """Large buckets are compared in blocks: here every bucket is large, and blocks are tiny."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 1)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 5)
    rows = near_corpus(3, 12, seed=5)
    got = minhash.near_duplicates(table(spark, rows), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(rows, 2)


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    got = minhash.near_duplicates(table(spark, rows), 2).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by_id[2]} == {1} and {r.component_id for r in by_id[10]} == {9}
    assert {r.component_id for r in by_id[11]} == {9} and {r.component_id for r in by_id[7]} == {6}
    assert all(r.component_id is None and r.kept for r in by_id[None])
    assert all(by_id[i][0].n_shingles == 0 and by_id[i][0].kept for i in (3, 4, 5))
    assert [r.component_id for r in by_id[12]] == [12, 12]
    kept = minhash.drop_near_duplicates(table(spark, rows), 2)
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 8, 9, 12, 12, 13]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    assert minhash.near_duplicates(table(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, share in ((20, 0.8), (300, 0.8), (5000, 0.5), (300, 0.0)):
        found = []
        for _ in range(40):
            values = np.unique(common.mix(rng.integers(0, 2 ** 63, 3 * size).astype(np.uint64)))
            rng.shuffle(values)
            both = int(2 * size * share / (1 + share))
            a, b = values[:size], np.concatenate([values[:both], values[size:2 * size - both]])
            sketch = minhash.registers(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]))
            found.append(minhash.jaccard_estimate(sketch[:1], sketch[1:], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(found) - both / (2 * size - both)) < 0.03


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (50, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 0, **{i: 100 for i in range(100, 130)}}


def test_exact_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    got = exact.exact_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (keep, len(ids))
        assert not r.kept or r.doc_id == keep
    assert sum(r.kept for r in got) == len(groups)
    kept = exact.drop_exact_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and kept.count() == len(groups)


def test_digest_index_grows(spark):
    path = scratch_dir(spark, "index")
    index = exact.DigestIndex(spark, path, buckets=3)
    first = exact.exact_duplicates(table(spark, [(1, "a"), (2, "b"), (3, "a")]), index).collect()
    assert sorted(r.doc_id for r in first if r.kept) == [2, 3]
    again = exact.DigestIndex(spark, path, buckets=3)
    second = exact.exact_duplicates(table(spark, [(9, "a"), (8, "c"), (7, "c")]), again).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in second} == {9: (3, False), 8: (8, True), 7: (8, False)}
    assert again.rows().count() == 3
    plan = again.rows().select("digest")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()
    assert exact.exact_duplicates(table(spark, [])).count() == 0


def test_words_are_hashed_alike_wherever_they_stand():
    texts = ["Aa b\tcc", "", "  cc ", "b"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    words, counts = common.hashed_words(np.frombuffer(data, np.uint8), offsets)
    assert counts.tolist() == [3, 0, 1, 1]
    assert words[2] == words[3] and words[1] == words[4] and len(set(words.tolist())) == 3


def test_words_with_equal_polynomial_sums_are_told_apart(spark):
    one, two = alternating()
    rows = [(1, f"{one} x"), (2, f"{two} x"), (3, one), (4, two), (5, f"{one}  X")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows), 2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    rows = [("tail " * 3 + one).encode(), ("tail " * 3 + two).encode()]
    offsets = np.cumsum([0] + [len(r) for r in rows])
    words, _ = common.hashed_words(np.frombuffer(b"".join(rows), np.uint8), offsets)
    assert len(set(words.tolist())) == 3


@pytest.mark.parametrize("width", [1, 2, 5])
def test_numbered_shingles_equal_sets(width):
    rng = random.Random(width)
    texts = [" ".join(rng.choice("abC") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    numbers, sizes = common.numbered_shingles(common.words_of(data, offsets), width)
    sets = [shingles(t, width) for t in texts]
    assert sizes.tolist() == list(map(len, sets))
    parts = [set(p.tolist()) for p in np.split(numbers, np.cumsum(sizes)[:-1])]
    assert all(len(parts[i] & parts[j]) == len(sets[i] & sets[j]) for i in range(40) for j in range(40))


def test_index_is_reopened_with_other_settings(spark):
    path = scratch_dir(spark, "index") + "/re-opened"
    rows = [(i, f"text {i}") for i in range(400)]
    first = exact.exact_duplicates(table(spark, rows), exact.DigestIndex(spark, path, buckets=8)).collect()
    assert sum(r.kept for r in first) == 400
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.sql(f"DROP TABLE {exact.DigestIndex(spark, path).table}")  # as a new session, which knows the path only
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        again = exact.DigestIndex(spark, path)
        assert again.buckets == 8
        known = exact.exact_duplicates(table(spark, rows), again).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(known) == 400 and not any(r.kept for r in known)
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, path, buckets=9)
    assert exact.DigestIndex(spark, path + "/").table == again.table
    assert exact.DigestIndex(spark, path.replace("-", "_")).table != again.table


def test_batch_given_again_after_its_append(spark):
    docs = table(spark, [(1, "a"), (2, "b"), (3, "a"), (3, "a")])
    index = exact.DigestIndex(spark, scratch_dir(spark, "index") + "/batches", buckets=3)
    key = lambda rows: sorted(map(tuple, rows))
    exact.exact_duplicates(table(spark, [(9, "b")]), index, "earlier").collect()
    first = key(exact.exact_duplicates(docs, index, "one").collect())
    assert key(exact.exact_duplicates(docs, index, "one").collect()) == first
    assert [r[0] for r in first if r[3]] == [3]
    assert [r.doc_id for r in exact.drop_exact_duplicates(docs, index, "one").collect()] == [3]
    assert not any(r.kept for r in exact.exact_duplicates(docs, index, "two").collect())
    assert index.unbucketed().count() == 2


def test_every_round_of_components_frees_the_driver(spark, monkeypatch):
    import importlib

    module, freed, rounds = importlib.import_module("lintlake.llm.components"), [], []
    free, write = module.free_driver, module.written
    monkeypatch.setattr(module, "free_driver", lambda session: (freed.append(1), free(session)))
    monkeypatch.setattr(module, "written", lambda df, name: (rounds.append(name), write(df, name))[1])
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {tuple(r) for r in module.components(links).collect()} == {(i, 0) for i in range(61)}
    assert len(freed) == len(rounds) > 2
