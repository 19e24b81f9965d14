"""Importance resampling towards a target distribution, with hashed n-gram features.

Features are runs of one to three words; a feature's bucket is the CRC-32 of its bytes.  Words
and pairs that are frequent in the corpus form the head, a vocabulary of bounded size that is
broadcast: for each head word the exact CRC state of its bytes, for each frequent pair its
bucket.  States continue each other exactly (appending n bytes is a linear map
of the state, tabulated by n), so a feature made of head words costs a few table reads for a
whole batch at once.  A word of the tail is hashed directly from its bytes wherever it occurs and
its features go on from that; with a word too long for the table they are hashed from their own
bytes.  Which words are in the head only decides the speed, never a bucket.

All documents and all target texts are counted; the counts are two rows of ``buckets`` numbers,
whatever the input.  Ranks come from a range-sorted table and one offset a partition.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, ship, worker_cache, written

ship(__name__)

BUCKETS, LONGEST_RUN = 10000, 3
#: Words and pairs of the head, and the bytes of its longest word.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 32768, 65536, 32
#: Slots of the table of frequent pairs; a pair whose slot is taken by a more frequent one is no head pair.
SLOTS = 1 << 18
#: Words that a task counts before it hands on what is frequent among them, and words handled together.
COUNTED, RUN_WORDS = 1 << 22, 1 << 16
#: Bytes of a text that are cut into words together.
PIECE = 1 << 19

_WORDS = np.full(256, 32, np.uint8)  # what is no part of a word becomes a blank
_WORDS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_WORDS[65:91] = range(97, 123)
_WORDS = _WORDS.tobytes()


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column):
        value = text.as_py()
        yield value.encode() if value else b""


def word_runs(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text in runs of bounded length; the second value says how many repeat the run before."""
    tail: list[bytes] = []
    plain, start = text.translate(_WORDS), 0
    while start < len(plain):
        end = len(plain) if len(plain) - start <= PIECE else plain.find(b" ", start + PIECE)
        words = plain[start:end if end >= 0 else len(plain)].split()
        start = end + 1 if end >= 0 else len(plain)
        if words:
            yield tail + words, len(tail)
            tail = (tail + words)[1 - LONGEST_RUN:]


# --- CRC states ------------------------------------------------------------------------

def crc_step() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def shift_tables(longest: int) -> np.ndarray:
    """[n, byte of the state, its value]: what the state becomes when n bytes follow, before their own CRC."""
    step = crc_step()
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    tables = np.zeros((longest + 1, 4, 256), np.uint32)
    values = np.arange(256)
    for n in range(longest + 1):
        for byte in range(4):
            for bit in range(8):
                tables[n, byte, (values >> bit & 1) == 1] ^= bits[8 * byte + bit]
        bits = (bits >> np.uint32(8)) ^ step[bits & np.uint32(255)]
    return tables


_SHIFT: dict[int, np.ndarray] = {}
_BLANK = np.uint32(zlib.crc32(b" "))


def continued(states: np.ndarray, lengths: np.ndarray, more: np.ndarray) -> np.ndarray:
    """CRC of each left side followed by a right side of ``lengths`` bytes and CRC ``more``."""
    if not _SHIFT:
        _SHIFT[0] = shift_tables(HEAD_BYTES)
    t = _SHIFT[0]
    return (t[lengths, 0, states & np.uint32(255)] ^ t[lengths, 1, states >> np.uint32(8) & np.uint32(255)]
            ^ t[lengths, 2, states >> np.uint32(16) & np.uint32(255)] ^ t[lengths, 3, states >> np.uint32(24)] ^ more)


# --- the head ----------------------------------------------------------------------------

def _counted(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and pairs with their counts, in portions of bounded size.

        Of a large portion only what occurs more than once in a million is handed on.
        """
        number, codes, n = defaultdict(count().__next__), [], 0

        def portion():
            nonlocal number, codes, n
            names, least, parts = list(number), 1 + (n >> 20), np.concatenate([np.zeros(0, np.int64)] + codes)
            number, codes, n = defaultdict(count().__next__), [], 0
            counts = np.bincount(parts[parts >= 0], minlength=len(names))
            kept = np.flatnonzero(counts >= least)
            keys, key_counts = np.unique(((parts[:-1] << 32) + parts[1:])[(parts[:-1] >= 0) & (parts[1:] >= 0)],
                                         return_counts=True)
            keys, key_counts = keys[key_counts > least], key_counts[key_counts > least]
            pairs = [names[a] + b" " + names[b] for a, b in zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist())]
            return pa.record_batch([pa.array([names[i] for i in kept.tolist()] + pairs, pa.binary()),
                                    pa.array(np.concatenate([counts[kept], key_counts]))], ["key", "n"])

        for batch in batches:
            for text in texts_of(batch, column):
                for words, known in word_runs(text):
                    codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                    if known > 1:  # the repeated words stay for the pair across the border only
                        codes[-1][:known - 1] = -1
                    codes.append(np.full(1, -1, np.int64))
                    n += len(words)
                    if n >= COUNTED:
                        yield portion()
        yield portion()
    return run


class Head:
    """Frequent words and pairs with their exact CRC states."""

    def __init__(self, words: list[bytes], pairs: list[bytes]):
        self.code = {w: i for i, w in enumerate(words)}
        self.lengths = np.array([len(w) for w in words] + [0], np.int64)
        self.states = np.array([zlib.crc32(w) for w in words] + [0], np.uint32)
        self.blank = np.array([zlib.crc32(w + b" ") for w in words] + [0], np.uint32)  # state after "word "
        self.pair_key, self.pair_bucket = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)
        for pair in pairs:  # the most frequent first
            a, b = (self.code.get(w, -1) for w in pair.split(b" "))
            if a >= 0 and b >= 0:
                key = a * len(self.states) + b
                slot = self.slot(key)
                if self.pair_key[slot] < 0:
                    self.pair_key[slot], self.pair_bucket[slot] = key, zlib.crc32(pair) % BUCKETS

    @staticmethod
    def slot(keys):
        return (keys * 0x9E3779B1 >> 15) & (SLOTS - 1)

    def buckets(self, words: list[bytes], fresh: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and word (the last one) of every feature that ends at a ``fresh`` word.

        ``place`` is a word's number within its text, or 2 and more where that is known to be so.
        """
        code = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        head, lengths, states, blank = code >= 0, self.lengths[code], self.states[code], self.blank[code]
        tail = np.flatnonzero(~head)
        unseen = [words[i] for i in tail.tolist()]
        states[tail] = np.fromiter(map(zlib.crc32, unseen), np.uint32, len(unseen))
        blank[tail] = continued(states[tail], np.ones(len(tail), np.int64), _BLANK)
        lengths[tail] = np.fromiter(map(len, unseen), np.int64, len(unseen))
        long = lengths > HEAD_BYTES
        found, at, state = [], [], states
        for length in range(1, LONGEST_RUN + 1):
            ends = np.flatnonzero(fresh & (place >= length - 1))
            if length == 2:  # states of all pairs, at their second word
                state = np.zeros(len(words), np.uint32)
                state[1:] = continued(blank[:-1], np.where(long, 0, lengths)[1:], states[1:])
                bucket = state.astype(np.int64) % BUCKETS
                seen = np.flatnonzero(head[:-1] & head[1:]) + 1
                keys = code[seen - 1] * len(self.states) + code[seen]
                slots = self.slot(keys)
                known = self.pair_key[slots] == keys
                bucket[seen[known]] = self.pair_bucket[slots[known]]
            elif length == 3:
                state = np.append(np.zeros(1, np.uint32), state[:-1])
                state = continued(continued(state, np.ones(len(state), np.int64), _BLANK), np.where(long, 0, lengths), states)
                bucket = state.astype(np.int64) % BUCKETS
            else:
                bucket = states.astype(np.int64) % BUCKETS
            bucket = bucket[ends]
            if length > 1 and long.any():  # a word longer than the table of states goes
                stale = long[ends] | (long[ends - 1] if length == 3 else False)
                for i in np.flatnonzero(stale).tolist():
                    bucket[i] = zlib.crc32(b" ".join(words[ends[i] - length + 1:ends[i] + 1])) % BUCKETS
            found.append(bucket)
            at.append(ends)
        return np.concatenate(found), np.concatenate(at)


def frequent(docs: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words and pairs of all texts: at most HEAD_WORDS and HEAD_PAIRS, whatever the input.

    A histogram of counts says from which count on so many are left, so nothing is sorted.
    """
    pair = F.col("key").cast("string").contains(" ")
    counts = written(docs.select("text").mapInArrow(_counted(0), "key binary, n bigint").groupBy("key").agg(
        F.sum("n").alias("n")).withColumn("pair", pair).withColumn("level", F.floor(F.log2("n") * 8))
        .where(F.length("key") <= F.when(F.col("pair"), 2 * HEAD_BYTES + 1).otherwise(HEAD_BYTES)), "counts")
    # eight rows for each doubling of the largest count
    levels = sorted(map(tuple, counts.groupBy("pair", "level").agg(F.count("*").alias("n")).collect()), reverse=True)
    found = []
    for of_pairs, room in ((False, HEAD_WORDS), (True, HEAD_PAIRS)):
        least = None
        for is_pair, level, n in levels:
            if is_pair == of_pairs:
                room -= n
                if room < 0:
                    break
                least = level
        kept = counts.where((F.col("pair") == of_pairs) & (F.col("level") >= least)).collect() if least is not None else []
        found.append([bytes(r["key"]) for r in sorted(kept, key=lambda r: (-r["n"], r["key"]))])
    return found[0], found[1]


# --- passes over the texts -------------------------------------------------------------------

def _features(batches: Iterator[pa.RecordBatch], column: int, head: Head) -> Iterator[tuple]:
    """For runs of texts: (batch, its first text, texts, buckets, text of each feature, words of each text).

    A long text comes in several runs; the batch is given with the last one only.
    """
    for batch in batches:
        words, fresh, place, of, n_words, first = [], [], [], [], [], 0

        def made(last):
            nonlocal words, fresh, place, of, n_words, first
            buckets, at = head.buckets(words, np.concatenate(fresh), np.concatenate(place)) if words else (
                np.zeros(0, np.int64), np.zeros(0, np.int64))
            texts = np.concatenate(of)[at] - first if words else at
            out = first, last, buckets, texts, np.array(n_words, np.int64)
            words, fresh, place, of, n_words, first = [], [], [], [], [], last
            return out

        for no, text in enumerate(texts_of(batch, column)):
            n_words.append(0)
            for run_words, known in word_runs(text):
                if known:  # a further run of a long text: what came before is summed up on its own
                    yield batch, *made(no), False
                    n_words = [0]
                words += run_words
                fresh.append(np.arange(len(run_words)) >= known)
                place.append(np.arange(len(run_words)))
                of.append(np.full(len(run_words), no))
                n_words[-1] += len(run_words) - known
            if len(words) >= RUN_WORDS:
                yield batch, *made(no + 1), True
        yield batch, *made(len(batch)), True


def _head(shared) -> Head:
    cache = worker_cache()
    if cache.get("resampling head", (None,))[0] != shared.value[2]:
        cache["resampling head"] = shared.value[2], Head(*shared.value[:2])
    return cache["resampling head"][1]


def _totals(shared, target: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, head = np.zeros(BUCKETS, np.int64), _head(shared)
        for _, _, _, buckets, _, _, _ in _features(batches, 0, head):
            counts += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.full(len(held), target)), pa.array(held), pa.array(counts[held])],
                              ["target", "bucket", "n"])
    return run


def _weights(shared, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, words, features and weight of every row."""
        head, current, words, features, weights = _head(shared), None, None, None, None

        def row_batch():
            return pa.record_batch([current.column(0), pa.array(words), pa.array(features), pa.array(weights)],
                                   ["doc_id", "n_words", "n_features", "weight"])

        for batch, first, last, buckets, texts, n_words, _ in _features(batches, 1, head):
            if batch is not current:
                if current is not None:
                    yield row_batch()
                current = batch
                words, features, weights = (np.zeros(len(batch), np.int64) for _ in range(3))
            n = len(n_words)
            words[first:first + n] += n_words
            features[first:first + n] += np.bincount(texts, minlength=n)[:n]
            # gains are integers far below 2**53, so sums of doubles are exact
            weights[first:first + n] += np.bincount(texts, gains[buckets], n)[:n].astype(np.int64)
        if current is not None:
            yield row_batch()
    return run


def bucket_gains(counts: list[tuple[bool, int, int]]) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of a bucket's shares of the target and of the documents)."""
    own, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for of_target, bucket, n in counts:
        (target if of_target else own)[bucket] = n
    s_all, t_all = int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(own.tolist(), target.tolist())], float)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with their place (from 1) in a total order, without a window over all of them."""
    spark: SparkSession = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lined = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "lined")
    counts = lined.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return lined.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn(
        "place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: str = "42") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; ``rank`` is null unless drawn.

    Features are all runs of one to three words of the lower-cased text (null: none).  The
    weight of a document adds the gains of its features' buckets; the score adds a Gumbel
    variable made from doc_id, so that the highest scores are a draw without replacement.  Of
    the N rows with ``least_words`` words, floor(percent * N / 100) are drawn, ties to the
    smaller doc_id.  A null doc_id is hashed as an empty text and comes last in ties; repeated
    rows are rows of their own and may be drawn each.  Further columns are not looked at;
    empty tables count nothing; an empty table of documents gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    goal = target.select(target["text"].cast("string").alias("text"))
    words, pairs = frequent(texts)
    shared = spark.sparkContext.broadcast((words, pairs, hash((tuple(words), tuple(pairs)))))
    own = texts.select("text").mapInArrow(_totals(shared, False), "target boolean, bucket bigint, n bigint")
    theirs = goal.mapInArrow(_totals(shared, True), "target boolean, bucket bigint, n bigint")
    counts = own.unionByName(theirs).groupBy("target", "bucket").agg(F.sum("n").alias("n")).collect()  # two rows a bucket
    gains = bucket_gains([tuple(r) for r in counts])
    weighed = texts.mapInArrow(_weights(shared, gains), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(name, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weighed.withColumn("score", (F.col("weight") + gumbel).cast("bigint")), "scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    placed = ranked(scored.where(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    place = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.withColumn("rank", place).drop("place").unionByName(
        scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))).select(
        "doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))
