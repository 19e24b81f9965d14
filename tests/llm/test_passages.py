import random

import numpy as np

from helpers import odd_rows, table
from lintlake.llm import passages


def corpus(seed=2):
    """Random texts; some hold one passage, whole, with changed words, or with words left out."""
    rng = random.Random(seed)
    word = lambda: f"r{rng.randint(0, 10 ** 9)}"
    passage = [word() for _ in range(70)]
    rows, want = [], {}
    for i in range(30):
        before, after = [word() for _ in range(rng.randint(0, 120))], [word() for _ in range(rng.randint(0, 120))]
        part = []
        if i % 3 == 0:
            part = list(passage)
            if i % 2:
                for n in (20, 45):
                    part[n] = word()
            if i % 5 == 0:
                del part[33]
            want[i] = (len(before), len(before) + len(part))
        rows.append((i, " ".join(before + part + after)))
    return rows, want


def test_planted_passages_are_found_and_others_left_alone(spark):
    rows, want = corpus()
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == set(want)
    assert {r.doc_id for r in got} == set(want) - {0}
    for r in got:
        for found, (a, b) in (((r.start_word, r.end_word), want[r.doc_id]), ((r.other_start, r.other_end), want[r.other_id])):
            assert abs(found[0] - a) <= 3 and abs(found[1] - b) <= 3
        assert 0.9 <= r.identity <= 1


def test_passages_of_odd_rows(spark):
    rows = odd_rows()
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(10, 9), (11, 9)}
    assert all((r.start_word, r.end_word, r.identity) == (0, 60, 1.0) for r in got)
    assert passages.repeated_passages(table(spark, [])).count() == 0
    same = " ".join(f"w{i}" for i in range(80))
    assert passages.repeated_passages(table(spark, [(1, same + " x " + same), (1, same)])).count() == 0


def plain_scores(rows, cost):
    score = []
    for s, o, n in sorted(map(tuple, rows.tolist())):
        best = 0.0
        for (s2, o2, n2), v in score:
            if s2 + n2 <= s and o2 + n2 <= o:
                best = max(best, v - cost * (s - s2 - n2 + o - o2 - n2))
        score.append(((s, o, n), n + best))
    return score


def test_tree_gives_the_best_chains():
    rng = np.random.default_rng(3)
    for _ in range(50):
        rows = np.unique(np.stack([rng.integers(0, 60, 25), rng.integers(0, 60, 25), rng.integers(1, 9, 25)], axis=1), axis=0)
        score, before = passages.chain_scores(rows, 0.25)
        want = plain_scores(rows, 0.25)
        assert np.allclose(sorted(score), sorted(v for _, v in want))
        for j, i in enumerate(before):
            assert i < 0 or (rows[i, 0] + rows[i, 2] <= rows[j, 0] and rows[i, 1] + rows[i, 2] <= rows[j, 1])


def test_common_words_equal_the_table():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert passages.common_words(np.array(a, np.uint32), np.array(b, np.uint32)) == best[-1][-1]


def test_equal_runs_choose_a_common_seed():
    rng = np.random.default_rng(9)
    k, w = passages.SEED_WORDS, passages.WINDOW
    run = rng.integers(0, 2 ** 63, k + w - 1).astype(np.uint64)
    keys = []
    for _ in range(2):
        words = np.concatenate([rng.integers(0, 2 ** 63, 40).astype(np.uint64), run, rng.integers(0, 2 ** 63, 30).astype(np.uint64)])
        keys.append(set(passages.minimizers(words, np.array([len(words)]), k, w)[0].tolist()))
    assert keys[0] & keys[1]


def test_passage_whose_parts_occur_earlier_is_found_whole(spark):
    rng = random.Random(4)
    words = lambda n: [f"r{rng.randint(0, 10 ** 9)}" for _ in range(n)]
    passage = words(80)
    texts = {1: passage[:40], 2: passage[40:], 3: passage[20:60], 5: passage, 9: passage}
    rows = {i: words(rng.randint(5, 30)) + t + words(20) for i, t in texts.items()}
    got = passages.repeated_passages(table(spark, [(i, " ".join(t)) for i, t in rows.items()])).collect()
    covered = {(r.doc_id, p) for r in got for p in range(r.start_word, r.end_word)}
    n = passages.MIN_WORDS
    for i, own in rows.items():
        for p in range(len(own) - n + 1):
            if any(own[p:p + n] == t[q:q + n] for j, t in rows.items() if j < i for q in range(len(t) - n + 1)):
                assert {(i, x) for x in range(p, p + n)} <= covered
    assert {(r.doc_id, r.other_id) for r in got} == {(9, 5)}


def test_short_fuzzy_passages_reach_alignment(spark):
    rng = random.Random(6)
    words = lambda n: [f"r{rng.randint(0, 10 ** 9)}" for _ in range(n)]
    rows = []
    for i in range(100):
        own = words(55)
        other = [words(1)[0] if rng.random() < 0.15 and 0 < n < 54 else w for n, w in enumerate(own)]
        rows += [(2 * i, " ".join(words(30) + own + words(30))), (2 * i + 1, " ".join(words(30) + other + words(30)))]
    got = passages.repeated_passages(table(spark, rows), min_words=45).collect()
    assert len({r.doc_id for r in got}) >= 80
    assert all(r.other_id == r.doc_id - 1 and r.identity >= 0.8 for r in got)


def test_two_passages_with_other_words_between_are_both_found():
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 2 ** 32, (2, 60), dtype=np.uint32)
    a, b = (np.concatenate([one, rng.integers(0, 2 ** 32, 80, dtype=np.uint32), two]) for _ in range(2))
    rows = np.array([[0, 0, 60], [140, 140, 60]])
    got = sorted(x[:2] for x in passages.passages_of(rows, a, b, 50, 0.8))
    assert got == [(0, 60), (140, 200)]


def test_links_of_a_diagonal_are_one_row_and_only_broken_runs_are_longer_seeds():
    import pyarrow as pa

    # 20 seeds linked to document 1, then 20 to document 2; a gap; 30 to document 1
    pos = [*range(40), *range(60, 90)]
    other = [1] * 20 + [2] * 20 + [1] * 30
    at = [*range(5, 25), *range(100, 120), *range(50, 80)]
    table = pa.table({"doc_id": [9] * 70, "pos": pos, "other_id": other, "other_pos": at})
    got = sorted(tuple(r.values()) for r in passages._runs(6, [12, 50])(table).to_pylist())
    # runs of 12 words over the break: their 7 seeds start at 14 to 19
    assert got == [(9, 0, 1, 0, 5, 20), (9, 0, 1, 60, 50, 30), (9, 0, 2, 20, 100, 20), (9, 12, 9, 14, 14, 6)]


def test_a_text_with_many_spans_is_sent_in_few_rows(spark, monkeypatch):
    rng = random.Random(12)
    words = lambda n: [f"r{rng.randint(0, 10 ** 9)}" for _ in range(n)]
    passage, seen = words(60), []
    rows = [(i, " ".join(words(9) + passage + words(9))) for i in range(40)]
    monkeypatch.setattr(passages, "SPANS", 16)
    write = passages.written

    def watched(df, name):
        if name == "slices":
            seen.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(passages, "written", watched)
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.other_id, r.end_word - r.start_word) for r in got) == [(i, 0, 60) for i in range(1, 40)]
    assert "collect_list" in seen[0]


def test_chains_that_cannot_pass_send_no_words(spark, monkeypatch):
    rng = random.Random(14)
    words = lambda n: [f"r{rng.randint(0, 10 ** 9)}" for _ in range(n)]
    common, passage, sizes = words(9), words(60), {}
    rows = [(i, " ".join(words(70) + common + words(70) + (passage if i > 37 else []))) for i in range(40)]
    write = passages.written

    def watched(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(passages, "written", watched)
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert [(r.doc_id, r.other_id, r.end_word - r.start_word) for r in got] == [(39, 38, 60)]
    assert sizes["chains"] == 40 and sizes["slices"] == 1
    assert spark.conf.get(passages.CLEANUP, None) in (None, "false")


def test_seeds_are_sent_in_ten_bytes():
    import pyarrow as pa

    rng = np.random.default_rng(15)
    texts = [" ".join(f"r{x}" for x in rng.integers(0, 10 ** 9, 400)) for _ in range(800)]
    batch = pa.record_batch([pa.array(range(800), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sent = list(passages._deal_seeds(passages._seeds(6, 1))([batch]))
    n = sum(sum(b.column("n").to_pylist()) for b in sent)
    assert n == 800 * 395
    assert sum(len(x) for b in sent for x in b.column("columns").to_pylist()) < 11 * n
    back = np.concatenate(list(passages._by_part(iter(sent), 3)), axis=1)
    want = [np.concatenate([b.column(i).to_numpy() for b in passages._seeds(6, 1)([batch])]) for i in range(3)]
    assert sorted(zip(*back.tolist())) == sorted(zip(*(c.tolist() for c in want)))


def test_bounds_leave_every_passage_open():
    rng = np.random.default_rng(16)
    passed = 0
    for _ in range(400):
        n, m = rng.integers(40, 200, 2)
        a, b = rng.integers(0, 2 ** 32, n, dtype=np.uint32), rng.integers(0, 2 ** 32, m, dtype=np.uint32)
        size = int(rng.integers(30, min(n, m) + 1))
        p, q = int(rng.integers(0, n - size + 1)), int(rng.integers(0, m - size + 1))
        b[q:q + size] = np.where(rng.random(size) < rng.uniform(0.7, 1), a[p:p + size], b[q:q + size])
        at = int(rng.integers(0, size - 6))
        b[q + at:q + at + 6] = a[p + at:p + at + 6]
        rows = np.array([[p + at, q + at, 6]])
        span = lambda x, k: (np.array([0]), np.array([k]))
        may = passages.may_pass((a >> 24).astype("u1"), np.array([0]), span(p, n), (b >> 24).astype("u1"), np.array([0]),
                                span(q, m), rows, 200, 50, 0.8)
        found = list(passages.passages_of(rows, a, b, 50, 0.8))
        passed += bool(found)
        assert may[0] or not found
    assert 50 < passed < 350


def test_pairs_without_links_between_fragments_are_told_apart():
    rng = np.random.default_rng(17)
    several = 0
    for _ in range(300):
        m = int(rng.integers(1, 90))
        rows = np.unique(np.stack([rng.integers(0, 900, m), rng.integers(0, 900, m), rng.integers(6, 9, m)], axis=1), axis=0)
        longest = max(len(c) for c in passages.chains(rows, 0.25))
        found = passages.chained(np.zeros(len(rows), np.int64), rows, 0.25).tolist()
        several += longest > 1
        assert found == [0] or longest == 1
    assert several > 20


def test_runs_of_documents_are_those_of_each():
    import pyarrow as pa

    rng = np.random.default_rng(18)
    rows = np.concatenate([np.stack([np.full(60, d), np.arange(60), np.repeat(rng.integers(0, 4, 12), 5), np.arange(60) + 7], axis=1)
                           for d in (3, 8, 5)])
    names = ["doc_id", "pos", "other_id", "other_pos"]
    run = passages._runs(6, [12, 24])
    both = sorted(tuple(r.values()) for r in run(pa.table(dict(zip(names, rows.T)))).to_pylist())
    each = [r for d in (3, 5, 8) for r in run(pa.table(dict(zip(names, rows[rows[:, 0] == d].T)))).to_pylist()]
    assert both == sorted(tuple(r.values()) for r in each)


def test_spans_of_a_pair_are_sent_once():
    pair, low, high = np.array([1, 0, 1, 1]), np.array([30, 0, 10, 90]), np.array([60, 5, 40, 95])
    of, start, stop, at = passages.joined_spans(pair, low, high)
    assert list(zip(of, start, stop)) == [(0, 0, 5), (1, 10, 60), (1, 90, 95)]
    assert at.tolist() == [25, 0, 5, 55]


def test_chains_of_one_fragment_grow_as_others():
    rng = np.random.default_rng(19)
    longer = 0
    for _ in range(300):
        n, m = rng.integers(40, 250, 2)
        a, b = (rng.integers(0, 2 ** 32, x, dtype=np.uint32) for x in (n, m))
        size = int(rng.integers(8, min(n, m) + 1))
        p, q = int(rng.integers(0, n - size + 1)), int(rng.integers(0, m - size + 1))
        b[q:q + size] = np.where(rng.random(size) < rng.uniform(0.6, 1), a[p:p + size], b[q:q + size])
        at = int(rng.integers(0, size - 6))
        row = np.array([[p + at, q + at, int(rng.integers(6, size - at + 1))]])
        span = lambda x: (np.array([0]), np.array([x]))
        before, after, matched = passages.single_passages(a, np.array([0]), span(n), b, np.array([0]), span(m), row, 250)
        (s, e, s2, e2, equal), = passages.align(row, a, b, passages.MAX_GAP)
        x, y, k = row[0].tolist()
        assert (x - before[0], x + k + after[0], y - before[0], y + k + after[0], matched[0]) == (s, e, s2, e2, equal)
        longer += before[0] + after[0] > 20
    assert longer > 50


def test_fuzzy_passages_whose_runs_occur_earlier_are_found(spark):
    """Every equal run of the passage is held first by a document that holds nothing else of it."""
    rng = random.Random(21)
    words = lambda n: [f"r{rng.randint(0, 10 ** 9)}" for _ in range(n)]
    own = words(63)
    changed = [words(1)[0] if n % 8 == 7 else w for n, w in enumerate(own)]
    runs = [own[n:n + 7] for n in range(0, 63, 8)]
    rows = [(i, " ".join(words(20) + t + words(20))) for i, t in enumerate(runs)]
    rows += [(i, " ".join(words(120) + t + words(120))) for i, t in ((40, own), (50, changed))]
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(50, 40)}
    assert len({p for r in got for p in range(r.start_word, r.end_word)}) >= 60


def test_further_holders_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(22)
    words = lambda n: [f"r{rng.randint(0, 10 ** 9)}" for _ in range(n)]
    common, passages_ = words(7), [words(60) for _ in range(8)]
    rows = [(i, " ".join(words(70) + passages_[i % 8][:30] + common + passages_[i % 8][30:] + words(70))) for i in range(8, 24)]
    rows = [(i, t if i < 16 else " ".join(w if n % 7 else f"{w}x{i}" if w not in common else w for n, w in enumerate(t.split())))
            for i, t in rows]
    rows.append((0, " ".join(common)))
    rows += [(100 + 10 * i + j, " ".join(p[n:n + 6])) for i, p in enumerate(passages_) for j, n in enumerate(range(0, 54, 6))]
    one = sorted(tuple(r) for r in passages.repeated_passages(table(spark, rows)).collect())
    monkeypatch.setattr(passages, "BLOCK", 5)
    assert sorted(tuple(r) for r in passages.repeated_passages(table(spark, rows)).collect()) == one
    assert {(r[0], r[3]) for r in one} == {(i, i - 8) for i in range(16, 24)}
