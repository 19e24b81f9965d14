import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import odd_rows, table
from lintlake.llm import mixing, packing, store, tokens
from lintlake.session import scratch_dir

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ENCODERS = {p: tokens.Encoder(p, s) for p, s in ((WORDS, False), (BYTES, True))}


def plain(path, text):
    tokenizer = ENCODERS[path].tokenizer
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab's.S,! \n\t 1éßÄ日𝒳-_") + ["́", " ", "\x1c"]), max_size=25), max_size=4))
def test_encoder_equals_the_tokenizer(texts):
    for path, encoder in ENCODERS.items():
        assert [x.tolist() for x in encoder.encode(texts)] == [plain(path, t) for t in texts]


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "UNITS", 20)
    for path, spaced in ((WORDS, False), (BYTES, True)):
        encoder = tokens.Encoder(path, spaced)
        for n in range(5):
            texts = [f"word{n}{i} it's <|endoftext|> x{i}." for i in range(12)]
            assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) <= 20


@pytest.mark.parametrize("n", [10, 11])
def test_units_with_equal_hashes_are_told_apart(n):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [one, two, f"{one} x {two} {one}", f"{two}é\u3000 日", f"{one}é\u3000 日", two]
    for path, spaced in ((WORDS, False), (BYTES, True)):
        encoder = tokens.Encoder(path, spaced)
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(texts)] == [plain(path, t) for t in texts]


def test_any_hash_gives_the_tokenizer_s_ids(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "_keys", staticmethod(
        lambda low, starts, ends, odd: ((ends - starts) % 3).astype(np.uint64)))
    texts = ["the cat sat on the mat", "The mat sat, on (the) cat!", "日 the 本 cat  sat", ""]
    for path, spaced in ((WORDS, False), (BYTES, True)):
        encoder = tokens.Encoder(path, spaced)
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(texts)] == [plain(path, t) for t in texts]


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_of_odd_rows(spark):
    rows = odd_rows()
    got = packing.pack_documents(table(spark, rows), WORDS, capacity=512).collect()
    want = []
    for r in rows:
        ids = plain(WORDS, r[1]) + [1]
        want += [(r[0], p, s, len(ids[s:s + 512]), zlib.crc32(np.array(ids[s:s + 512], "<u4").tobytes()))
                 for p, s in enumerate(range(0, len(ids), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = check_packing(got, 512)
    assert len(sequences) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack_documents(table(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_place_keeps_every_limit(score):
    rng = random.Random(4)
    lengths = np.array(sorted((rng.randint(1, 100) for _ in range(400)), reverse=True))
    bins, offsets = packing.place(lengths, 100, 4, 5000.0, (1.0, 0.5, 0.5), score)
    for b in set(bins.tolist()):
        own, at = lengths[bins == b], offsets[bins == b]
        assert own.sum() <= 100 and len(own) <= 4
        assert len(own) == 1 or (own.astype(float) ** 2).sum() <= 5000
        assert sorted(zip(at.tolist(), own.tolist())) == [(int(own[np.argsort(at)][:i].sum()), int(own[np.argsort(at)][i])) for i in range(len(own))]
    free, _ = packing.place(lengths, 100, 400, 1e9, (1.0, 0.0, 0.0), score)
    assert len(set(free.tolist())) <= -(-lengths.sum() // 100) + 2


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_place_is_decided_by_all_three_residuals(score):
    """Bins equal those of a plain search over the vector, and differ from best fit by tokens alone."""
    rng = random.Random(11)
    lengths = sorted((min(1000, 1 + int(25 * rng.paretovariate(0.7))) for _ in range(300)), reverse=True)
    limits, weights = (1000, 5, 9e5), packing.WEIGHTS
    assert all(w > 0 for w in weights)
    full = sum(n == 1000 for n in lengths)
    bins, want = [[0, 0, 0] for _ in range(full)], list(range(full))
    for n in lengths[full:]:
        need, best = (n, 1, n * n), None
        for b, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need)):
                parts = [(w * x / m, w * y / m) for w, x, y, m in zip(weights, left, need, limits)]
                value = sum(x * y for x, y in parts) if score == "dot" else -sum((x - y) ** 2 for x, y in parts)
                if best is None or value > best[0] + 1e-12:
                    best = value, b
        if best is None:
            bins.append([max(x, y) for x, y in zip(limits, need)])
            best = 0, len(bins) - 1
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need)]
        want.append(best[1])
    got, _ = packing.place(np.array(lengths), *limits, weights, score)
    assert got.tolist() == want
    alone, _ = packing.place(np.array(lengths), *limits, (1.0, 0.0, 0.0), "norm")
    assert alone.tolist() != want
    wide = (1000, 1000, 1000.0 ** 2)  # as a packing without further limits has them
    assert packing.place(np.array(lengths), *wide, weights, score)[0].tolist() != \
        packing.place(np.array(lengths), *wide, (1.0, 0.0, 0.0), "norm")[0].tolist()
    assert len(set(packing.place(np.array(lengths), *wide, weights, score)[0].tolist())) <= -(-sum(lengths) // 1000) + 1


def test_packing_follows_the_order_of_the_files(spark, tmp_path):
    rows = [(i, "word " * (i % 7)) for i in range(300)]
    path = str(tmp_path / "ordered")
    table(spark, rows).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    got = packing.pack_documents(docs, WORDS, capacity=64, group=packing.read_order(docs, 10)).collect()
    check_packing(got, 64)
    runs = {}
    for r in got:
        runs.setdefault(r.sequence_id >> packing.BIN_BITS, []).append(r.doc_id)
    assert sorted(i for ids in runs.values() for i in ids) == list(range(300))
    ordered = [runs[g] for g in sorted(runs)]
    assert len(ordered) >= 30 and max(map(len, ordered)) <= 10
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))
    assert packing.read_order(table(spark, rows)) is None


def test_ids_wider_than_the_store_raise(spark):
    with pytest.raises(Exception, match="does not fit"):
        store.token_store(table(spark, [(1, "some plain words")]), BYTES, width=1).count()


def test_store_round_trip(spark):
    rows = odd_rows()
    folder = scratch_dir(spark, "store")
    got = store.token_store(table(spark, rows), BYTES, folder=folder).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for r in ordered:
        ids = plain(BYTES, r[1]) + [0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    opened = store.TokenStore(spark, folder)
    keys = spark.createDataFrame([(1, 0), (2, 1), (99, 0), (12, 1), (12, 2), (None, 0), (1, 0)], "doc_id bigint, occurrence bigint")
    assert sorted(((r.doc_id, r.occurrence) for r in opened.read(keys).collect()), key=repr) == sorted(
        [(1, 0), (2, 1), (12, 1), (None, 0)], key=repr)
    assert store.token_store(table(spark, []), BYTES).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(2).integers(0, 2 ** 63, 5000).astype(np.uint64))
    table_ = store.PerfectHash.load(store.PerfectHash.build(keys).dump())
    assert sorted(table_.find(keys).tolist()) == list(range(len(keys)))
    other = table_.find(keys + np.uint64(1))
    assert ((other >= -1) & (other < len(keys))).all()
    with pytest.raises(ValueError):
        store.PerfectHash.build(np.array([5, 5], np.uint64))


def fill(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        own = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, t in own.items() if t >= cap * sizes[s]}
        if not over:
            return {**own, **{s: cap * sizes[s] for s in full}}
        full |= over


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None, rng.choice(["a"] * 8 + ["b", "c", "é", "𝒳", None])) for i in range(600)]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = fill(sizes)
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        assert r.position is None or -1e-9 <= r.position <= 1 + 1e-9
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions)
    again = {(r.doc_id, r.taken, r.position) for r in mixing.mix(table(spark, rows).repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken, r.position) for r in got}


def test_mixing_whole_documents_and_odd_rows(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    got = mixing.mix(docs, whole=True).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    want = {}
    texts = {}
    for r in docs.withColumn("k", mixing._order_key(docs)).collect():
        texts[r.k] = (r.doc_id, r.text)
    for r in got:
        n = r.taken // r.size if r.size else int(r.position is not None)
        want[texts[r.order_key]] = want.get(texts[r.order_key], 0) + n
    assert times == {k: n for k, n in want.items() if n}
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mixed_documents(table(spark, [])).count() == 0


def test_mixed_documents_follow_the_curriculum(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"u{i} " + " ".join(["w"] * rng.randint(0, 30)), None, rng.choice("aaaaaabc")) for i in range(300)]
    docs = table(spark, rows)
    sizes, texts = {}, {r[0]: r for r in rows}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    target, rank, want = fill(sizes), {s: i for i, s in enumerate(sorted(sizes))}, {}
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(docs, whole=True).collect()}
    for s in sizes:
        before = 0
        own = [r for r in docs.where(docs["source"] == s).withColumn("k", mixing._order_key(docs)).collect()]
        for r in sorted(own, key=lambda r: r.k):
            for n in range(times[r.doc_id]):
                q = min(1.0, (n * sizes[s] + before) / target[s])
                pieces = mixing.SCHEDULES[rank[s] % 3]
                low, high = pieces[0][1], pieces[-1][1]
                at = q if low == high else (np.sqrt(low * low + 2 * (high - low) * q) - low) / (high - low)
                want.setdefault(r.doc_id, []).append(at)
            before += len(texts[r.doc_id][1].split())
    mixing.mixed_documents(docs).write.parquet(str(tmp_path / "mixed"))
    import pyarrow.parquet as pq
    got = [i for f in sorted((tmp_path / "mixed").glob("part-*")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert len(got) == sum(map(len, want.values())) and max(map(len, want.values())) == 2
    positions = [want[i].pop(0) for i in got]
    assert all(a <= b + 1e-9 for a, b in zip(positions, positions[1:]))
