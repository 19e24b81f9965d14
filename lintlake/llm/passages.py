"""Repeated passages between documents by collinear chaining of seeds.

Every word k-mer is a seed.  A seed joins every document that has it to the first document that
has it.  Where a run of seeds is shared, longer runs of words, up to the least passage, are seeds as
well: each has a first document of its own, so a whole passage is joined to one that holds it whole
also where its parts occur earlier elsewhere.  For every pair of documents joined, seeds on one diagonal are merged into fragments,
and the best chains of fragments that follow each other in both documents are found with a Fenwick
tree over the other document's positions, gaps costing by their length.  Chains are aligned on the words of both texts: fragments word by
word, the gaps between them by dynamic programming, the ends extended as long as it pays.

Places whose seeds are shared but that lie in no passage with a first document are then tried with
every earlier document that holds the seed: occurrences of a seed meet each other in blocks, with
one byte of each word around them, and those whose diagonal can hold a passage are chained and aligned as well.

Seeds and links are sent as compressed columns, many in a row.  Words are sent for chains only
that can be long and equal enough by one byte of each word, which bounds the equal words from above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bounded_batches, hashed_words, mix, ship, text_chunks, written

ship(__name__)

SEED_WORDS = 6
WINDOW = 1
MIN_WORDS = 50
IDENTITY = 0.8
#: Cost of a word that a chain leaves out, in either document.
GAP_COST = 0.25
#: Seeds of one diagonal that are further apart are fragments of their own.
MAX_STEP = 24
#: A gap of more words than this, in either document, ends a passage.
MAX_GAP = 200
#: Words beyond its seeds that a passage may grow by; an equal run has a seed every few words.
MARGIN = 100
#: Pairs whose spans are cut out of a text together.
SPANS = 1024
#: Parts that seeds are dealt to by their hash, links by their document.
PARTS = 2048
#: Seeds or links that a task sends together.
SENT = 1 << 21
#: Chains whose bounds are computed together.
BOUNDED = 4096
#: Fragments after one that are tried as the next of its chain before the tree is asked.
TRIED = 64
#: Shuffle files go when the table made of them is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SEEDS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])
#: Occurrences of a seed that are compared together with others.
BLOCK = 16384
#: Pairs of occurrences compared together, and occurrences held for that, but for those of one seed.
COMPARED = 1 << 16
HELD = 4096
_RUNS = pa.schema([("doc_id", pa.int64()), ("length", pa.int32()), ("other_id", pa.int64()), ("start", pa.int32()),
                   ("other_start", pa.int32()), ("n", pa.int32())])
_PACKED = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("columns", pa.binary())])
#: Four numbers a fragment: start, other start, length, and 1 if a chain begins with it.
_WANTED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("tag", pa.int64()), ("blocks", pa.int32())])
_AROUND = pa.schema([*_WANTED, ("low", pa.int32()), ("high", pa.int32()), ("words", pa.binary())])
_MATCHES = pa.schema([("doc_id", pa.int64()), ("other_id", pa.int64()), ("start", pa.int32()), ("other_start", pa.int32()),
                      ("n", pa.int32())])
_CHAINS = pa.schema([("doc_id", pa.int64()), ("other_id", pa.int64()), ("fragments", pa.list_(pa.int32()))])
_WORDS = pa.schema([("doc_id", pa.int64()), ("words", pa.binary())])
_SLICES = pa.schema([*_CHAINS, ("other_size", pa.int32()), ("other_words", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()),
                     ("other_id", pa.int64()), ("other_start", pa.int64()), ("other_end", pa.int64()),
                     ("matched", pa.int64()), ("identity", pa.float64())])


def minimizers(words: np.ndarray, counts: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hash, text number, word position) of the least k-mer of every w that follow each other."""
    lasts = np.cumsum(counts)
    firsts = lasts - counts
    of = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    if n < k + w - 1:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    acc = np.zeros(n - k + 1, U64)
    for j in range(k):
        acc = mix(acc * U64(0xD6E8FEB86659FD93) + words[j:n - k + 1 + j])
    m = len(acc) - w + 1
    least = acc[:m].copy()
    for s in range(1, w):
        np.minimum(least, acc[s:m + s], out=least)
    whole = np.arange(m) + w + k - 2 < lasts[of[:m]]  # the window's last word is in the same text
    chosen = np.zeros(len(acc), bool)
    for s in range(w):
        chosen[s:m + s] |= whole & (acc[s:m + s] == least)
    at = np.flatnonzero(chosen)
    return acc[at], of[at], at - firsts[of[at]]


def _seeds(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_chunks(batch):
                key, of, pos = minimizers(*hashed_words(data, offsets), k, w)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids[first:last][of]),
                                       pa.array(pos.astype(np.int32))], schema=_SEEDS)
    return run


def packed(*columns: np.ndarray) -> bytes:
    """64-bit integers, compressed with the bytes of one rank side by side: small ones and small steps take little."""
    ranks = np.stack([c.astype(np.int64) for c in columns]).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return pa.compress(ranks.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, columns: int) -> np.ndarray:
    ranks = np.frombuffer(pa.decompress(data, 8 * n * columns, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return ranks.transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]


def _dealt(tables: Iterator[tuple[np.ndarray, ...]], by: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PACKED`` of columns whose column ``by`` decides the part; column 1 is kept as its steps."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        part = columns[by].astype(U64) if by == 0 else mix(columns[by].astype(U64))
        part = (part % U64(PARTS)).astype(np.uint16)
        order = np.argsort(part, kind="stable")  # by counting, for 16 bits
        columns, part = [c[order] for c in columns], part[order]
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(cut[1:], len(part))
        rows = []
        for a, b in zip(cut.tolist(), ends.tolist()):
            own = [c[a:b] for c in columns]
            own[1] = np.diff(own[1], prepend=0)
            rows.append(packed(*own))
        step = 256
        for i in range(0, len(rows), step):
            yield pa.record_batch([pa.array(part[cut[i:i + step]], pa.int32()), pa.array((ends - cut)[i:i + step], pa.int32()),
                                   pa.array(rows[i:i + step], pa.binary())], schema=_PACKED)

    for table in tables:
        if len(table[0]):
            held.append(table)
            size += len(table[0])
        if size >= SENT:
            yield from sent()
            size = 0
    if held:
        yield from sent()


def _by_part(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """The columns of each part; rows come in the order of the parts."""
    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        for row, (part, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if part != now and held:
                yield np.concatenate(held, axis=1)
                held = []
            own = unpacked(batch.column(2)[row].as_py(), n, columns)
            own[1] = np.cumsum(own[1])
            held.append(own)
            now = part
    if held:
        yield np.concatenate(held, axis=1)


def _deal_rows(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(make(batches), 0)
    return run


def _deal_seeds(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # seeds as (key, doc_id, pos)
        return _dealt((tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in make(batches)), 0)
    return run


def first_links(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(other_id, doc_id, pos, other_pos) of seeds that several documents have; the first of them is the other."""
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    order = order[np.append(False, same) | np.append(same, False)]  # most seeds come once
    key, doc, pos = key[order], doc[order], pos[order]
    if not len(key):
        return doc, doc, pos, pos
    first = np.flatnonzero(np.append(True, np.diff(key) != 0))
    n = np.diff(np.append(first, len(key)))
    least = np.minimum.reduceat(doc, first)
    keep = np.repeat(least < np.maximum.reduceat(doc, first), n)
    other = np.repeat(least, n)
    at = np.repeat(np.minimum.reduceat(np.where(doc == other, pos, 1 << 40), first), n)
    return other[keep], doc[keep], pos[keep], at[keep]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def ordered() -> Iterator[tuple[np.ndarray, ...]]:
        held, size = [], 0
        for seeds in _by_part(batches, 3):
            held.append(first_links(*seeds))
            size += len(held[-1][0])
            if size >= SENT:
                yield _in_order(held)
                held, size = [], 0
        if held:
            yield _in_order(held)
    return _dealt(ordered(), 1)


def _in_order(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    other, doc, pos, at = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((pos, doc))
    return other[order], doc[order], pos[order], at[order]


def _run_links(k: int, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(k, lengths)
        for other, doc, pos, at in _by_part(batches, 4):
            yield from runs(pa.table({"doc_id": doc, "pos": pos, "other_id": other, "other_pos": at})).to_batches()
    return run


def _long_seeds(k: int):
    """Runs of words as seeds: ``runs`` has their lengths, more than ``k``, first starts and numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_chunks(batch):
                words, counts = hashed_words(data, offsets)
                runs = batch.column(1)[first:last]
                length, start, n = (c.to_numpy().astype(np.int64) for c in runs.flatten().flatten())
                of = np.repeat(np.arange(last - first), runs.value_lengths().to_numpy())
                pos, size, of = _spread(start, n), np.repeat(length, n), np.repeat(of, n)
                inside = pos + size <= counts[of]  # a variant of the document can be shorter
                pos, size, of = pos[inside], size[inside], of[inside]
                acc = np.zeros(max(0, len(words) - k + 1), U64)
                for j in range(k):
                    acc = mix(acc * U64(0xD6E8FEB86659FD93) + words[j:len(acc) + j])
                # the run's k-mers from its first word, one after the other, and the one that ends it
                at, key = (np.cumsum(counts) - counts)[of] + pos, size.astype(U64)
                for j in range(0, int(size.max(initial=0)), k):
                    own = np.flatnonzero(size > j)
                    key[own] = mix(key[own] * U64(0xD6E8FEB86659FD93) + acc[at[own] + np.minimum(j, size[own] - k)])
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids[first:last][of]), pa.array(pos.astype(np.int32))],
                                      schema=_SEEDS)
    return run


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of runs of ``n`` numbers from ``start``."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _cuts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of the runs in which ``columns`` grow by the same as the place: 1 for the last, 0 for others."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.diff(columns[-1]) != 1
        for c in columns[:-1]:
            new[1:] |= np.diff(c) != 0
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _runs(k: int, lengths: list[int]):
    """Links of documents: those that follow each other on a diagonal as one row, with length 0, or -1 to the document itself.

    For each of ``lengths`` also the starts of runs of so many words whose seeds are all shared but
    not all linked to one place of one document.  Where they are, their first holder is that of
    the whole run: it has the first of each seed.  All that hold a run agree on this.
    """
    def run(table: pa.Table) -> pa.Table:
        doc, pos, other, at = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "pos", "other_id", "other_pos"))
        out = []
        order = np.lexsort((pos, pos - at, other, doc))
        d, p, q, o = doc[order], pos[order], at[order], other[order]
        first, n = _cuts(d, o, p - q, p)
        out.append((d[first], np.where(o[first] == d[first], -1, 0), o[first], p[first], q[first], n))
        if lengths:
            ids, of = np.unique(doc, return_inverse=True)
            place = (of << 32) + pos
            order = np.lexsort((at, other, place))
            p, q, o = place[order], at[order], other[order]
            same = np.append(False, (np.diff(p) == 1) & (np.diff(o) == 0) & (np.diff(p - q) == 0))
            places, start = np.unique(p, return_index=True)
            # a place has one link, unless it is of several variants
            whole = same[start] & (np.diff(np.append(start, len(p))) == 1)
            breaks = np.cumsum(~whole)
            for length in lengths:
                need = length - k
                i = np.arange(max(0, len(places) - need))
                starts = places[i[(places[i + need] - places[i] == need) & (breaks[i + need] > breaks[i])]]
                first, n = _cuts(starts)
                d, p = ids[starts[first] >> 32], starts[first] & 0xFFFFFFFF
                out.append((d, np.full(len(first), length), d, p, p, n))
        doc, length, other, start, other_start, n = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array(doc), pa.array(length, pa.int32()), pa.array(other), pa.array(start, pa.int32()),
                         pa.array(other_start, pa.int32()), pa.array(n, pa.int32())], schema=_RUNS)
    return run


def fragments(pair: np.ndarray, start: np.ndarray, other: np.ndarray, n: np.ndarray, k: int,
              step: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, rows (start, other start, length)) of runs of seeds merged along diagonals, in order of pair and start."""
    order = np.lexsort((start, start - other, pair))
    pair, start, other, n = pair[order], start[order], other[order], n[order]
    group = np.cumsum(np.append(False, (np.diff(pair) != 0) | (np.diff(start - other) != 0))[:len(pair)]) << 40
    last = np.maximum.accumulate(group + start + n - 1)
    cut = np.flatnonzero(np.append(True, group[1:] + start[1:] - last[:-1] > step)[:len(pair)])
    last = last[np.append(cut[1:], len(pair)) - 1] - group[cut]
    rows = np.stack([start[cut], other[cut], last - start[cut] + k], axis=1)
    order = np.lexsort((rows[:, 1], rows[:, 0], pair[cut]))
    return pair[cut][order], rows[order]


class _Fenwick:
    """Largest (value, item) of a prefix."""

    def __init__(self, n: int):
        self.tree = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.tree):
            if value > self.tree[i]:
                self.tree[i] = value
            i += i & -i

    def best(self, n: int) -> tuple[float, int]:
        found = (-np.inf, -1)
        while n > 0:
            found = max(found, self.tree[n])
            n -= n & -n
        return found


def chain_scores(rows: np.ndarray, cost: float) -> tuple[list[float], list[int]]:
    """Best score of a chain that ends in each fragment, and the fragment before it (-1: none).

    A fragment scores its length; a chain pays ``cost`` for each word between two fragments,
    in either document.  A sweep over the first document meets starts and ends in order; the
    tree holds finished fragments by their end in the other.
    """
    n = len(rows)
    start, other, length = (rows[:, i].tolist() for i in range(3))
    ends = sorted(range(n), key=lambda i: start[i] + length[i])
    other_ends = np.sort(rows[:, 1] + rows[:, 2])
    place = np.searchsorted(other_ends, rows[:, 1] + rows[:, 2], "right").tolist()
    room = np.searchsorted(other_ends, rows[:, 1], "right").tolist()
    tree, score, before, done = _Fenwick(n), [0.0] * n, [-1] * n, 0
    for j in sorted(range(n), key=lambda i: (start[i], other[i])):
        while done < n and start[ends[done]] + length[ends[done]] <= start[j]:
            i = ends[done]
            tree.put(place[i] - 1, (score[i] + cost * (start[i] + other[i] + 2 * length[i]), i))
            done += 1
        value, i = tree.best(room[j])
        gain = value - cost * (start[j] + other[j])
        score[j] = length[j] + max(0.0, gain)
        before[j] = i if gain > 0 else -1
    return score, before


def chains(rows: np.ndarray, cost: float) -> Iterator[np.ndarray]:
    """Fragments of each chain from the best down, no fragment twice."""
    score, before = chain_scores(rows, cost)
    used = [False] * len(rows)
    for j in sorted(range(len(rows)), key=lambda i: -score[i]):
        own = []
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(j)
            j = before[j]
        if own:
            yield rows[own[::-1]]


def chained(pair: np.ndarray, rows: np.ndarray, cost: float) -> np.ndarray:
    """Pairs that may have chains of several fragments.

    The first fragment of a chain scores its length, so where none reaches another with that,
    each is a chain of its own.
    """
    start, other, n = rows.T
    reach = start + n + n / cost
    found = []
    at = np.arange(len(rows))
    for ahead in range(1, TRIED + 1):
        at = at[at + ahead < len(rows)]
        at = at[(pair[at + ahead] == pair[at]) & (start[at + ahead] < reach[at])]
        if not len(at):
            break
        gap, gap2 = (rows[at + ahead, i] - rows[at, i] - n[at] for i in (0, 1))
        found.append(pair[at[(gap >= 0) & (gap2 >= 0) & (cost * (gap + gap2) < n[at])]])
    return np.unique(np.concatenate([*found, pair[at]]))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values.reshape(-1), pa.int32()))


def _chain(k: int, cost: float, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            runs = batch.column(2)
            start, at, n = (c.to_numpy().astype(np.int64) for c in runs.flatten().flatten())
            pair = np.repeat(np.arange(len(batch)), runs.value_lengths().to_numpy())
            pair, rows = fragments(pair, start, at, n, k, step)
            head = np.ones(len(rows), np.int64)
            for i in chained(pair, rows, cost).tolist():
                a, b = np.searchsorted(pair, [i, i + 1])
                found = list(chains(rows[a:b], cost))
                rows[a:b] = np.concatenate(found)
                head[a:b] = np.concatenate([np.arange(len(c)) == 0 for c in found])
            sizes = 4 * np.bincount(pair, minlength=len(batch))
            yield pa.record_batch([batch.column(0), batch.column(1), _lists(np.column_stack([rows, head]), sizes)], schema=_CHAINS)
    return run


def _coded(kind: str):
    """The first bits of the hash of each word of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = U64(64 - 8 * np.dtype(kind).itemsize)
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch):
                words, counts = hashed_words(data, offsets)
                yield pa.record_batch([batch.column(0)[first:last], _binaries((words >> bits).astype(kind), counts)], schema=_WORDS)
    return run


def _binaries(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(counts)) * words.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)),
                                                                  pa.py_buffer(words.tobytes())]).cast(pa.binary())


def _flat_words(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column, and their number by row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    words = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(words).view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _flat_chains(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, fragments) of all chains of a column, first and last fragment of each chain."""
    rows = column.flatten().to_numpy().astype(np.int64).reshape(-1, 4)
    pair = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy() // 4)
    first = np.flatnonzero(rows[:, 3])
    return pair, rows, first, np.append(first[1:], len(rows)) - 1


def _ends(rows: np.ndarray, first: np.ndarray, last: np.ndarray, side: int, size: np.ndarray,
          margin: int) -> tuple[np.ndarray, np.ndarray]:
    """What a chain spans in a text of ``size`` words, and what a passage may grow by."""
    return np.maximum(rows[first, side] - margin, 0), np.minimum(rows[last, side] + rows[last, 2] + margin, size)


def joined_spans(pair: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each pair without what they share: (pair, low, high), and where in all of them each span begins."""
    order = np.lexsort((low, pair))
    base = pair[order] << 40
    begin, end = base + low[order], np.maximum.accumulate(base + high[order])
    new = np.append(True, begin[1:] > end[:-1])[:len(pair)]
    first = np.flatnonzero(new)
    start, stop = begin[first], end[np.append(first[1:], len(pair)) - 1]
    place = np.cumsum(stop - start) - (stop - start) - start
    at = np.empty(len(pair), np.int64)
    at[order] = place[np.cumsum(new) - 1] + begin
    return start >> 40, start & ((1 << 40) - 1), (stop - start) + (start & ((1 << 40) - 1)), at


def _prefix(kind: str):
    """The first byte or bytes of the codes of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = _flat_words(batch.column(1), "u4")
            yield pa.record_batch([batch.column(0), _binaries((words >> np.uint32(32 - 8 * np.dtype(kind).itemsize)).astype(kind), counts)],
                                  schema=_WORDS)
    return run


def _slice(margin: int, kind: str):
    """The words of a text that chains span and may grow by, instead of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            others, pairs, texts = batch.columns
            words, counts = _flat_words(texts, kind)
            text = np.repeat(np.arange(len(batch)), pairs.value_lengths().to_numpy())
            doc, flat = pairs.flatten().flatten()
            pair, rows, first, last = _flat_chains(flat)
            low, high = _ends(rows, first, last, 1, counts[text[pair[first]]], margin)
            keep = low < high  # a variant of the document can be shorter
            of, start, stop, _ = joined_spans(pair[first][keep], low[keep], high[keep])
            begins = np.cumsum(counts) - counts
            own = words[_spread(begins[text[of]] + start, stop - start)]
            sizes = np.bincount(of, stop - start, minlength=len(doc)).astype(np.int64)
            yield pa.record_batch([doc, others.take(pa.array(text)), flat, pa.array(counts[text], pa.int32()),
                                   _binaries(own, sizes)], schema=_SLICES)
    return run


def _met(batch: pa.RecordBatch, margin: int, kind: str):
    """Pairs of a batch, and of each chain its fragments, spans, and where its words begin in those of both sides."""
    docs, pairs, texts = batch.columns
    a, counts = _flat_words(texts, kind)
    text = np.repeat(np.arange(len(batch)), pairs.value_lengths().to_numpy())
    other, flat, size, slices = pairs.flatten().flatten()
    b, _ = _flat_words(slices, kind)
    pair, rows, first, last = _flat_chains(flat)
    of = pair[first]
    own = _ends(rows, first, last, 0, counts[text[of]], margin)
    others = _ends(rows, first, last, 1, size.to_numpy().astype(np.int64)[of], margin)
    keep = others[0] < others[1]
    at = np.zeros(len(first), np.int64)
    at[keep] = joined_spans(of[keep], others[0][keep], others[1][keep])[3]
    begins = np.cumsum(counts) - counts
    return (docs.take(pa.array(text)), other, flat), (pair, rows, first, last), (a, begins[text[of]] + own[0], own), (b, at, others)


def may_pass(a: np.ndarray, a_at: np.ndarray, a_span: tuple, b: np.ndarray, b_at: np.ndarray, b_span: tuple, rows: np.ndarray,
             margin: int, min_words: int, identity: float) -> np.ndarray:
    """Which fragments lie in a stretch of their diagonal that is long and equal enough; of equal words their codes are equal."""
    out = np.zeros(len(rows), bool)
    share = int(identity * 10000)
    for i in range(0, len(rows), BOUNDED):
        own = slice(i, i + BOUNDED)
        p, q, n = rows[own, :3].T
        columns = np.arange(2 * margin + int(n.max()))
        x, y = p[:, None] - margin + columns, q[:, None] - margin + columns
        inside = (x >= a_span[0][own, None]) & (x < a_span[1][own, None]) & (y >= b_span[0][own, None]) & (y < b_span[1][own, None])
        x += (a_at[own] - a_span[0][own])[:, None]
        y += (b_at[own] - b_span[0][own])[:, None]
        equal = a[np.where(inside, x, 0)] == b[np.where(inside, y, 0)]
        value = (equal & inside) * 10000 - share
        sums = np.zeros((len(p), len(columns) + 1), np.int64)
        np.cumsum(value, axis=1, out=sums[:, 1:])
        least = np.minimum.accumulate(sums[:, :margin + 1], axis=1)
        ends = np.arange(margin, len(columns) + 1)
        best = sums[:, ends] - least[:, np.minimum(margin, ends - min_words)]
        out[own] = ((best >= 0) & (ends >= margin + n[:, None])).any(axis=1)
    return out


def _near(margin: int, min_words: int, identity: float):
    """Chains that may hold a passage: those of several fragments, and those that the codes of words leave open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            (doc, other, flat), (pair, rows, first, last), (a, a_at, own), (b, b_at, others) = _met(batch, margin, "u1")
            open_ = np.ones(len(first), bool)
            one = np.flatnonzero((first == last) & (rows[first, 2] < min_words))
            if len(one):
                found = np.zeros(len(one), bool)
                if len(a) and len(b):
                    found = may_pass(a, a_at[one], tuple(s[one] for s in own), b, b_at[one], tuple(s[one] for s in others),
                                     rows[first[one]], margin, min_words, identity)
                open_[one] = found
            keep = np.repeat(open_, last - first + 1)
            sizes = 4 * np.bincount(pair[keep], minlength=len(flat))
            some = np.flatnonzero(sizes)
            yield pa.record_batch([doc.take(pa.array(some)), other.take(pa.array(some)), _lists(rows[keep], sizes[some])], schema=_CHAINS)
    return run


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a longest common subsequence, row by row."""
    if not len(a) or not len(b):
        return 0
    before = np.zeros(len(b) + 1, np.int64)
    for word in a:
        now = before.copy()
        now[1:] = np.maximum(before[1:], before[:-1] + (b == word))
        before = np.maximum.accumulate(now)
    return int(before[-1])


def grown(equal: np.ndarray) -> int:
    """How many words an end grows by: the best sum of +1 for equal and -2 for other words."""
    if not len(equal):
        return 0
    sums = np.cumsum(np.where(equal, 1, -2))
    stop = np.flatnonzero(sums < np.maximum.accumulate(np.maximum(sums, 0)) - 8)
    sums = sums[:stop[0]] if len(stop) else sums
    best = int(sums.argmax()) if len(sums) else 0
    return best + 1 if len(sums) and sums[best] > 0 else 0


def grown_ends(equal: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`grown` of the first ``size`` words of each row, and how many words of it are equal."""
    columns = np.arange(equal.shape[1])
    sums = np.cumsum(np.where(equal, 1, -2), axis=1)
    low = sums < np.maximum.accumulate(np.maximum(sums, 0), axis=1) - 8
    gone = np.logical_or.accumulate(low | (columns >= size[:, None]), axis=1)
    sums = np.where(gone, -1, sums)
    best = sums.argmax(axis=1)
    n = np.where(sums[np.arange(len(sums)), best] > 0, best + 1, 0)
    return n, (equal & (columns < n[:, None])).sum(axis=1)


def align(rows: np.ndarray, a: np.ndarray, b: np.ndarray, gap: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, matched words) of the passages of a chain; ends exclusive."""
    start = end = None
    for p, q, n in rows.tolist():
        if start is not None and max(p - end[0], q - end[1]) > gap:
            yield _ended(a, b, start, end, matched)
            start = None
        same = a[p:p + n] == b[q:q + n] if len(a[p:p + n]) == len(b[q:q + n]) else np.zeros(0, bool)
        if start is None:
            size = min(p, q, gap)
            left = grown(a[p - size:p][::-1] == b[q - size:q][::-1])
            start, matched = (p - left, q - left), int((a[p - left:p] == b[q - left:q]).sum())
        else:
            matched += common_words(a[end[0]:p], b[end[1]:q])
        matched += int(same.sum())
        end = (p + n, q + n)
    if start is not None:
        yield _ended(a, b, start, end, matched)


def _ended(a, b, start, end, matched):
    size = min(len(a) - end[0], len(b) - end[1])
    right = grown(a[end[0]:end[0] + size] == b[end[1]:end[1] + size]) if size > 0 else 0
    matched += int((a[end[0]:end[0] + right] == b[end[1]:end[1] + right]).sum())
    return start[0], end[0] + right, start[1], end[1] + right, matched


def lengthened(a: np.ndarray, b: np.ndarray, found: tuple, min_words: int) -> tuple[int, int, int, int, int]:
    """A shorter passage brought to ``min_words`` words, its ends equal words, with the largest share of equal ones."""
    s, e, s2, e2, matched = found
    more = min_words - min(e - s, e2 - s2)
    if more <= 0:
        return found
    left, right = min(s, s2, 2 * more), max(0, min(len(a) - e, len(b) - e2, 2 * more))
    before = np.flatnonzero(np.append(True, (a[s - left:s] == b[s2 - left:s2])[::-1]))
    after = np.flatnonzero(np.append(True, a[e:e + right] == b[e2:e2 + right]))
    # a size's place among those that end in an equal word is the number of words gained
    other = np.searchsorted(after, more - before)
    fits = np.flatnonzero(other < len(after))
    if not len(fits):
        return found
    size = max(e - s, e2 - s2) + before[fits] + after[other[fits]]
    best = fits[((matched + fits + other[fits]) / size).argmax()]
    n, m = int(before[best]), int(after[other[best]])
    return s - n, e + m, s2 - n, e2 + m, matched + int(best + other[best])


def passages_of(rows: np.ndarray, a: np.ndarray, b: np.ndarray, min_words: int,
                identity: float) -> Iterator[tuple[int, int, int, int, int, float]]:
    """What :func:`align` finds that is long and equal enough; a chain that is not is split at its widest gap."""
    left = [rows]
    while left:
        rows = left.pop()
        passed = True
        for found in align(rows, a, b, MAX_GAP):
            s, e, s2, e2, matched = lengthened(a, b, found, min_words)
            share = matched / max(e - s, e2 - s2, 1)
            if share < identity:
                passed = passed and min(found[1] - found[0], found[3] - found[2]) < min_words
            elif min(e - s, e2 - s2) >= min_words:
                yield s, e, s2, e2, matched, share
        if not passed and len(rows) > 1:
            ends = rows[:-1, :2] + rows[:-1, 2:]
            at = int((rows[1:, :2] - ends).max(axis=1).argmax()) + 1
            left += [rows[at:], rows[:at]]


def single_passages(a: np.ndarray, a_at: np.ndarray, a_span: tuple, b: np.ndarray, b_at: np.ndarray, b_span: tuple,
                    rows: np.ndarray, margin: int) -> tuple[np.ndarray, ...]:
    """What :func:`align` finds for chains of one fragment inside both texts: words before and after it, and equal words."""
    p, q, n = rows[:, :3].T
    x, y = a_at + p - a_span[0], b_at + q - b_span[0]
    left = np.minimum(np.minimum(p - a_span[0], q - b_span[0]), MAX_GAP)
    right = np.minimum(a_span[1] - p, b_span[1] - q) - n
    steps = np.arange(margin)

    def equal(x, y, size):
        inside = steps < size[:, None]
        return a[np.where(inside, x, 0)] == b[np.where(inside, y, 0)]

    before, matched = grown_ends(equal((x - 1)[:, None] - steps, (y - 1)[:, None] - steps, left), left)
    after, more = grown_ends(equal((x + n)[:, None] + steps, (y + n)[:, None] + steps, right), right)
    own, at = np.repeat(np.arange(len(n)), n), _spread(np.zeros(len(n), np.int64), n)
    same = np.bincount(own, a[x[own] + at] == b[y[own] + at], minlength=len(n)).astype(np.int64)
    return before, after, matched + more + same


def _align(margin: int, min_words: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            (doc, other, _), (pair, rows, first, last), (a, a_at, own), (b, b_at, others) = _met(batch, margin, "u4")
            doc_id, other_id = doc.to_numpy(), other.to_numpy()
            p, q, n = rows[first, :3].T
            # those of one fragment inside both texts; where they are long enough as they are, that is all
            one = np.flatnonzero((first == last) & (p + n <= own[1]) & (q + n <= others[1]))
            done = np.zeros(len(first), bool)
            for i in range(0, len(one), BOUNDED):
                now = one[i:i + BOUNDED]
                before, after, matched = single_passages(
                    a, a_at[now], (own[0][now], own[1][now]), b, b_at[now], (others[0][now], others[1][now]), rows[first[now]], margin)
                size = before + n[now] + after
                share = matched / size
                done[now] = size >= min_words
                yes = (size >= min_words) & (share >= identity)
                now, before, size = now[yes], before[yes], size[yes]
                s, s2, of = p[now] - before, q[now] - before, pair[first[now]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(
                    (doc_id[of], s, s + size, other_id[of], s2, s2 + size, matched[yes], share[yes]), _RESULT)], schema=_RESULT)
            out: list[list] = [[] for _ in _RESULT]
            for i in np.flatnonzero(~done).tolist():
                f, z, begin, other_begin = int(first[i]), int(last[i]), int(own[0][i]), int(others[0][i])
                for s, e, s2, e2, matched, share in passages_of(
                        rows[f:z + 1, :3] - [begin, other_begin, 0], a[a_at[i]:a_at[i] + max(0, own[1][i] - begin)],
                        b[b_at[i]:b_at[i] + max(0, others[1][i] - other_begin)], min_words, identity):
                    for column, value in zip(out, (int(doc_id[pair[f]]), s + begin, e + begin, int(other_id[pair[f]]),
                                                   s2 + other_begin, e2 + other_begin, matched, share)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _RESULT)], schema=_RESULT)
    return run


def _open_seeds(k: int):
    """Seeds of shared ``places`` as (key, doc_id, pos, tag).

    The tag has the word before, 2 where the place before is no open one and 1 where the place is open: its seed is
    in none of the passages ``covered``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_chunks(batch):
                words, counts = hashed_words(data, offsets)
                begins = np.cumsum(counts) - counts
                shared = _marked(batch.column(1)[first:last], begins, counts, 0)
                covered = _marked(batch.column(2)[first:last], begins, counts, k - 1)
                key, of, pos = minimizers(words, counts, k, 1)
                at = begins[of] + pos
                keep = shared[at]
                key, of, pos, at = key[keep], of[keep], pos[keep], at[keep]
                open_ = shared & ~covered
                begin = (pos == 0) | ~open_[at - 1]
                before = np.where(pos == 0, 0, (words[at - 1] >> U64(34)).astype(np.int64) + 1)
                yield key.view(np.int64), ids[first:last][of], pos, before * 4 + 2 * begin + open_[at]
    return run


def _marked(runs: pa.ListArray, begins: np.ndarray, counts: np.ndarray, less: int) -> np.ndarray:
    """Which words of texts lie in runs (start, n), each ``less`` words shorter."""
    start, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in runs.flatten().flatten())
    of = np.repeat(np.arange(len(runs)), runs.value_lengths().fill_null(0).to_numpy())
    low = np.minimum(start, counts[of])
    high = np.clip(start + n - less, low, counts[of])  # a variant of the document can be shorter
    steps = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(steps, begins[of] + low, 1)
    np.add.at(steps, begins[of] + high, -1)
    return np.cumsum(steps)[:-1] > 0


def further_seeds(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc_id, key, pos, tag, occurrences) of seeds that an open place shares with more than its first occurrence.

    Where words before are the same and their seed open as well, that seed meets those occurrences.
    """
    order = np.lexsort((pos, doc, key))
    key, doc, pos, tag = key[order], doc[order], pos[order], tag[order]
    first = np.flatnonzero(np.append(True, np.diff(key) != 0)[:len(key)])
    if not len(first):
        return doc, key, pos, tag, doc
    n = np.diff(np.append(first, len(key)))
    later = (tag & 1 > 0) & (doc > np.repeat(doc[first], n))
    begins = np.logical_or.reduceat(later & (tag & 2 > 0), first)
    begins |= np.logical_or.reduceat(later, first) & (np.minimum.reduceat(tag >> 2, first) < np.maximum.reduceat(tag >> 2, first))
    keep = np.repeat((n > 2) & begins, n)
    keep[first] = False  # it was met as the first
    return doc[keep], key[keep], pos[keep], tag[keep], np.repeat(n, n)[keep]


def _further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for seeds in _by_part(batches, 4):
        doc, key, pos, tag, n = further_seeds(*seeds)
        columns = doc, key, pos, tag, -(-n // BLOCK)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _WANTED)], schema=_WANTED)


def _around(margin: int, k: int):
    """Occurrences of seeds with the codes of the words around them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.arange(-(-(2 * margin + k) // 8) * 8)
        for batch in batches:
            if not len(batch):
                continue
            docs, seeds, texts = batch.columns
            words, counts = _flat_words(texts, "u1")
            begins = np.cumsum(counts) - counts
            text = np.repeat(np.arange(len(batch)), seeds.value_lengths().to_numpy())
            key, pos, tag, blocks = (c.to_numpy().astype(np.int64) for c in seeds.flatten().flatten())
            inside = np.flatnonzero(pos + k <= counts[text])  # a variant of the document can be shorter
            for i in range(0, len(inside), COMPARED):
                own = inside[i:i + COMPARED]
                p, of = pos[own], text[own]
                low, high = np.maximum(margin - p, 0), np.minimum(margin - p + counts[of], 2 * margin + k)
                within = (columns >= low[:, None]) & (columns < high[:, None])
                at = np.where(within, (begins[of] + p - margin)[:, None] + columns, 0)
                size = np.full(len(own), len(columns))
                yield pa.record_batch([
                    docs.take(pa.array(of)), pa.array(key[own]), pa.array(p, pa.int32()), pa.array(tag[own]), pa.array(blocks[own], pa.int32()),
                    pa.array(low, pa.int32()), pa.array(high, pa.int32()), _binaries(np.where(within, words[at], 0).astype("u1"), size)],
                    schema=_AROUND)
    return run


def _outside(group: np.ndarray, kind: np.ndarray, own: np.ndarray, all_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``own`` with those of their group that are of another kind, or with all where ``all_``; rows by group and kind."""
    n = len(group)
    cut = np.append(True, np.diff(group) != 0)[:n]
    first = np.flatnonzero(cut)
    low, high = (x[np.cumsum(cut) - 1] for x in (first, np.append(first[1:], n)))
    cut[1:] |= np.diff(kind) != 0
    first = np.flatnonzero(cut)
    begin, end = (x[np.cumsum(cut) - 1] for x in (first, np.append(first[1:], n)))
    begin, end = np.where(all_, high, begin)[own], np.where(all_, high, end)[own]
    start, size = np.stack([low[own], end]).T.reshape(-1), np.stack([begin - low[own], high[own] - end]).T.reshape(-1)
    own = np.repeat(own, 2)
    sums = np.cumsum(size)
    i = 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + COMPARED, "right")))
        yield np.repeat(own[i:j], size[i:j]), _spread(start[i:j], size[i:j])
        i = j


def _equal_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from the first one are equal, row by row."""
    other = np.append(a != b, np.ones((len(a), 1), bool), axis=1)
    return other.argmax(axis=1)


class _Around:
    """Occurrences of seeds, those of one seed together, with the words around them."""

    def __init__(self, held: list[pa.RecordBatch], margin: int, k: int):
        table = pa.Table.from_batches(held).combine_chunks()
        key, doc, pos, tag, low, high, i, j, own = (table.column(c).to_numpy().astype(np.int64) for c in (
            "key", "doc_id", "pos", "tag", "low", "high", "i", "j", "own"))
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint8).reshape(len(doc), -1)
        order = np.lexsort((tag >> 2, j, i, key))
        key, i, j = key[order], i[order], j[order]
        self.doc, self.pos, self.tag, self.low, self.high = (x[order] for x in (doc, pos, tag, low, high))
        self.words, self.margin, self.k = words[order], margin, k
        self.side = np.where(i == j, -1, own[order])
        new = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        self.group = np.cumsum(np.append(False, new)[:len(key)])
        self.open = self.tag & 1 > 0
        self.begin = self.open & (self.tag & 2 > 0)

    def met(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which pairs are of an open occurrence and one of an earlier document; blocks of a seed meet once."""
        return (self.doc[two] < self.doc[one]) & ((self.side[one] < 0) | (self.side[one] != self.side[two])) & (
            self.begin[one] | (self.tag[one] >> 2 != self.tag[two] >> 2))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Open occurrences with those of earlier documents, where words before differ or the place before is not open."""
        for one, two in _outside(self.group, self.tag >> 2, np.flatnonzero(self.open), self.begin):
            met = self.met(one, two)
            yield one[met], two[met]

    def equal(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many words around two occurrences have equal codes at the same distance."""
        same = (self.words[one] == self.words[two]).view(np.uint64)
        # bytes of 0 and 1: the sums of up to 255 fit a byte
        equal = np.zeros(len(one), np.int64)
        for part in range(0, same.shape[1], 255):
            sums = same[:, part:part + 255].sum(axis=1)
            for j in range(8):
                equal += ((sums >> U64(8 * j)) & U64(255)).astype(np.int64)
        return equal - np.minimum(self.low[one], self.low[two]) - self.words.shape[1] + np.maximum(self.high[one], self.high[two])

    def length(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Words from the seed on that are equal by their codes."""
        n = _equal_runs(self.words[one, self.margin:], self.words[two, self.margin:])
        return np.minimum(n, np.minimum(self.high[one], self.high[two]) - self.margin)


def _meet(margin: int, k: int, min_words: int, identity: float):
    """Fragments of occurrences of a seed that can lie in one passage."""
    least = int(np.ceil(round(identity * min_words, 6)))

    def groups(batches):
        """Batches of whole groups."""
        held, size, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 8, 9)])
            new = (np.diff(ids, axis=1) != 0).any(axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)] if last is None or last != tuple(ids[:, 0]) else [
                *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            at = 0
            for cut in cuts[:-1]:
                if size + cut - at >= HELD:
                    held.append(batch.slice(at, cut - at))
                    yield held
                    held, size, at = [], 0, cut
            held.append(batch.slice(at))
            size += len(batch) - at
            last = tuple(ids[:, -1])
        if held:
            yield held

    def found(held):
        rows = _Around(held, margin, k)
        at = np.arange(len(rows.doc)) * rows.words.shape[1] + rows.low
        flat = rows.words.reshape(-1)
        for one, two in rows.pairs():
            some = rows.equal(one, two) >= least
            one, two = one[some], two[some]
            if len(one):
                seeds = np.tile([margin, margin, k], (len(one), 1))
                yes = may_pass(flat, at[one], (rows.low[one], rows.high[one]), flat, at[two], (rows.low[two], rows.high[two]), seeds,
                               margin, min_words, identity)
                one, two = one[yes], two[yes]
                yield rows.doc[one], rows.doc[two], rows.pos[one], rows.pos[two], rows.length(one, two) - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for held in groups(batches):
            for table in found(held):
                if len(table[0]):
                    kept.append(table)
                    size += len(table[0])
                if size >= COMPARED:
                    yield _matches(kept)
                    kept, size = [], 0
        if kept:
            yield _matches(kept)
    return run


def _matches(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = np.unique(np.stack([np.concatenate(c) for c in zip(*kept)]), axis=1)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _MATCHES)], schema=_MATCHES)


def _new_words(group: pd.DataFrame) -> pd.DataFrame:
    """Passages of a document, those with first documents and then by document, that cover words which none before covers."""
    group = group.sort_values(["later", "other_id", "start_word", "end_word", "other_start", "other_end"])
    covered = np.zeros(int(group["end_word"].max()), bool)
    keep = []
    for later, start, end in zip(group["later"], group["start_word"], group["end_word"]):
        keep.append(not later or not covered[start:end].all())
        covered[start:end] = True
    return group[keep].drop(columns="later")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, for which no shuffle file is kept."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _first_holders(seeds: DataFrame, k: int, lengths: list[int], name: str) -> DataFrame:
    """Runs of seeds that several documents have, each with its place in the first of them; of packed seeds."""
    rows = "part int, n int, columns binary"
    links = seeds.repartition("part").sortWithinPartitions("part").mapInArrow(_link, rows)
    return _stored(links.repartition("part").sortWithinPartitions("part").mapInArrow(
        _run_links(k, lengths), "doc_id bigint, length int, other_id bigint, start int, other_start int, n int"), f"runs-{name}")


def _slices(pairs: DataFrame, words: DataFrame, margin: int, kind: str) -> DataFrame:
    """Pairs with the words of the other document that their chains need."""
    # a text is sent once for SPANS of its pairs, and as often as it has variants
    place = F.row_number().over(Window.partitionBy("other_id").orderBy("doc_id"))
    cuts = pairs.withColumn("part", F.floor(place / SPANS)).groupBy("other_id", "part").agg(
        F.collect_list(F.struct("doc_id", "fragments")).alias("pairs"))
    return cuts.join(words.withColumnRenamed("doc_id", "other_id"), "other_id").select("other_id", "pairs", "words").mapInArrow(
        _slice(margin, kind), "doc_id bigint, other_id bigint, fragments array<int>, other_size int, other_words binary")


def _both(slices: DataFrame, words: DataFrame) -> DataFrame:
    """Documents with their words and their pairs."""
    return slices.groupBy("doc_id").agg(
        F.collect_list(F.struct("other_id", "fragments", "other_size", "other_words")).alias("pairs")).join(
        words, "doc_id").select("doc_id", "pairs", "words")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY,
                      seed_words: int = SEED_WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id, start_word, end_word, other_id, other_start, other_end, matched, identity.

    One row for each passage of at least ``min_words`` words that a document shares with the
    first document (smallest doc_id) in which one of its seeds occurs; ``identity`` is the share of its
    words that are aligned to equal ones (A-Z lower-cased, split at ASCII blanks).  Positions
    are words from 0, ends exclusive.  A run of ``seed_words + window - 1`` equal words always
    has a common seed; with a ``window`` of 1, each run of ``min_words`` words that an earlier
    document has too lies in a passage, and places that no such passage covers are tried with every
    earlier document that has their seed, at each of its places there, along the seed's diagonal.
    Of those the first documents count that cover words which none before covers.  Still missed are
    passages whose equal runs lie on several diagonals, none of which can hold one by itself, and
    all occur first in documents that do not hold the rest.  Null, empty and short texts have no passages; rows without doc_id take
    no part; rows that repeat a doc_id are variants of one document, which is never compared
    with itself.  Further columns are not looked at; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = "part int, n int, columns binary"
    seeds = texts.mapInArrow(_deal_seeds(_seeds(seed_words, window)), rows)
    lengths = sorted({n for n in (2 * seed_words, 4 * seed_words, min_words) if seed_words < n <= min_words})
    lengths = lengths if window == 1 else []
    runs = _first_holders(seeds, seed_words, lengths, "short")
    matches = runs.where("length = 0")
    if lengths:
        places = runs.where("length > 0").groupBy("doc_id").agg(F.collect_list(F.struct("length", "start", "n")).alias("runs"))
        longer = places.join(texts, "doc_id").mapInArrow(_deal_seeds(_long_seeds(seed_words)), rows)
        matches = matches.union(_first_holders(longer, seed_words, [], "long").where("length = 0"))
    whole = _stored(texts.mapInArrow(_coded("u4"), "doc_id bigint, words binary"), "words")
    found = _aligned(matches, whole, seed_words, min_words, identity, "")
    if window > 1:
        return found
    found = _stored(found, "found")
    more = _further_matches(texts, runs, found, whole, seed_words, min_words, identity)
    more = _stored(_aligned(more, whole, seed_words, min_words, identity, "further-"), "further")
    both = found.withColumn("later", F.lit(0)).union(more.withColumn("later", F.lit(1)))
    # a document whose words were all tried has its rows as they are
    again = both.join(more.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.join(more.select("doc_id").distinct(), "doc_id", "left_anti").select(*_RESULT.names).union(
        again.select(*_RESULT.names, "later").groupBy("doc_id").applyInPandas(_new_words, found.schema))


def _aligned(matches: DataFrame, whole: DataFrame, k: int, min_words: int, identity: float, name: str) -> DataFrame:
    """The passages of pairs of documents that ``matches`` joins."""
    pairs = matches.groupBy("doc_id", "other_id").agg(F.collect_list(F.struct("start", "other_start", "n")).alias("runs"))
    chain = "doc_id bigint, other_id bigint, fragments array<int>"
    pairs = _stored(pairs.select("doc_id", "other_id", "runs").mapInArrow(_chain(k, GAP_COST, MAX_STEP), chain), f"{name}chains")
    margin = max(MARGIN, min_words)
    codes = whole.mapInArrow(_prefix("u1"), "doc_id bigint, words binary")
    # variants of a document leave a pair open several times
    near = _stored(_both(_slices(pairs, codes, margin, "u1"), codes).mapInArrow(
        _near(margin, min_words, identity), chain).distinct(), f"{name}near")
    slices = _stored(_slices(near, whole, margin, "u4"), f"{name}slices")
    return _both(slices, whole).mapInArrow(
        _align(margin, min_words, identity), "doc_id bigint, start_word bigint, end_word bigint, other_id bigint, "
        "other_start bigint, other_end bigint, matched bigint, identity double").distinct()


def _further_matches(texts: DataFrame, runs: DataFrame, found: DataFrame, whole: DataFrame, k: int, min_words: int,
                     identity: float) -> DataFrame:
    """Fragments that documents share with others than the first holders, of seeds at places that no passage covers."""
    margin = max(MARGIN, min_words)
    places = _stored(runs.where("length <= 0").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("places")), "places")
    covered = found.groupBy("doc_id").agg(F.collect_list(F.struct(
        "start_word", (F.col("end_word") - F.col("start_word")).alias("n"))).alias("covered"))
    nothing = F.array().cast("array<struct<start_word: bigint, n: bigint>>")
    seeds = texts.join(places, "doc_id").join(covered, "doc_id", "left").select(
        "doc_id", "places", F.coalesce("covered", nothing).alias("covered"), "text").mapInArrow(
        _deal_rows(_open_seeds(k)), "part int, n int, columns binary")
    wanted = _stored(seeds.repartition("part").sortWithinPartitions("part").mapInArrow(
        _further, "doc_id bigint, key bigint, pos int, tag bigint, blocks int"), "wanted")
    codes = whole.mapInArrow(_prefix("u1"), "doc_id bigint, words binary")
    wide = "doc_id bigint, key bigint, pos int, tag bigint, blocks int, low int, high int, words binary"
    around = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "pos", "tag", "blocks")).alias("seeds")).join(
        codes, "doc_id").select("doc_id", "seeds", "words").mapInArrow(_around(margin, k), wide)
    dealt = around.withColumn("own", F.pmod(F.xxhash64("doc_id", "pos"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    dealt = dealt.select(*_AROUND.names, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    return _stored(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _meet(margin, k, min_words, identity), "doc_id bigint, other_id bigint, start int, other_start int, n int").distinct(),
        "further-matches")
