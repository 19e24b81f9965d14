"""Near duplicates by HyperMinHash.

One hash per shingle: its top bits choose one of 256 buckets and a bucket keeps the smallest
rest as a leading-zero count (6 bits) and mantissa bits (10).  Empty buckets borrow from a
bucket chosen by a fixed random sequence, so also short texts have full sketches and two equal
registers stay as likely as the similarity of the sets.  Bands of five registers propose
candidates: a pair of similarity 0.8 misses all 51 bands with a probability of 2e-9.  The
share of equal registers, corrected for chance collisions of the compressed values, gives a
Jaccard estimate; pairs far below the threshold are left out and all others are confirmed on
their full shingle sets.

Exact copies are folded into one representative first.  Then every bucket is a star around its
smallest document, in a second round around a member drawn by hash, and links found so far join
their documents into components.  The last round looks at what is left between components in a
bucket: small buckets give their untested pairs, documents of large buckets are dealt to blocks
and each pair of blocks is compared in memory, so no group is ever expanded into all its pairs
and every linked pair that shares a band ends in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    U64, bounded_batches, hashed_words, mix, numbered_shingles, shingle_sets, ship, text_chunks, tidy, words_of, written,
)
from .components import components

ship(__name__)

BUCKETS = 256
MANTISSA_BITS = 10
BAND_ROWS = 5
BANDS = BUCKETS // BAND_ROWS
#: Estimates may be this far below the threshold: six standard deviations of 256 registers.
MARGIN = 0.15
EMPTY = np.uint16(0xFFFF)
#: In the last round, buckets of up to so many members are expanded into pairs; those of larger
#: ones are compared in blocks.
SMALL_BUCKET = 24
#: Linked pairs share at least so many of 51 bands, but for 4 in 10**8.
SHARED_BANDS = 2
BLOCK_DOCS = 512
BLOCK_SHINGLES = 500_000

_TAIL_BITS = 56
_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                        ("digest", pa.binary()), ("sketch", pa.binary())])
_KEYS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def registers(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """uint16 registers (texts x 256) of sorted distinct shingle hashes; full unless a set is empty."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    slot = of * BUCKETS + (shingles >> U64(_TAIL_BITS)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]  # sorted: the first hash of a bucket is its minimum
    tail = shingles[first] & U64((1 << _TAIL_BITS) - 1)
    bits = np.frexp((tail >> U64(3)).astype(np.float64))[1].astype(np.int64) + 3
    bits = np.maximum(bits, MANTISSA_BITS + 1)
    zeros = _TAIL_BITS - bits
    mantissa = (tail >> (bits - MANTISSA_BITS - 1).astype(U64)) & U64((1 << MANTISSA_BITS) - 1)
    flat = np.full(len(sizes) * BUCKETS, EMPTY, np.uint16)
    flat[slot[first]] = (zeros << MANTISSA_BITS).astype(np.uint16) | mantissa.astype(np.uint16)
    return _filled(flat.reshape(-1, BUCKETS), sizes)


def _filled(sketch: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each empty bucket takes the value of the first filled one in its own random sequence."""
    row, column = np.nonzero((sketch == EMPTY) & (sizes > 0)[:, None])
    done, turn = sketch.copy(), 0
    while len(row):
        turn += 1
        source = (mix(column.astype(U64) + U64(turn * BUCKETS)) % U64(BUCKETS)).astype(np.int64)
        value = sketch[row, source]
        hit = value != EMPTY
        done[row[hit], column[hit]] = value[hit]
        row, column = row[~hit], column[~hit]
    return done


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of compressed registers (texts x bands)."""
    used = sketch[:, :BANDS * BAND_ROWS].astype(U64).reshape(-1, BANDS, BAND_ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64)), used.shape[:2]).copy()
    for j in range(BAND_ROWS):
        key = mix(key * U64(0xD6E8FEB86659FD93) + used[:, :, j])
    return key


def chance_collisions(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets of these sizes are equal by chance.

    Bucket minima are taken as exponential with the mean size of a bucket; within one
    leading-zero level a register value is a cell of equal width, so the integral is closed.
    """
    a, b = np.maximum(n_a, 1) / BUCKETS, np.maximum(n_b, 1) / BUCKETS
    total, both = np.zeros(len(a)), a + b
    for level in range(_TAIL_BITS - MANTISSA_BITS):
        low, high = 2.0 ** -(level + 1), 2.0 ** -level
        width = low / (1 << MANTISSA_BITS)
        total += width * a * b / both * (np.exp(-both * low) - np.exp(-both * high))
    return np.minimum(total, 0.5)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    chance = chance_collisions(n_a, n_b)
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, data, offsets in text_chunks(batch):
                words, counts = hashed_words(data, offsets)
                digests = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words_of(data, offsets)]
                shingles, sizes = shingle_sets(words, counts, width)
                sketch = registers(shingles, sizes)
                yield pa.record_batch([
                    ids.slice(first, last - first), pa.array(sizes.astype(np.int64)),
                    pa.array(digests, pa.binary()),
                    pa.array([row.tobytes() for row in sketch], pa.binary())], schema=_SIGNATURE)
    return run


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the word sequence, sketch (uint16 registers)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy("minhash", _sign(width)), "doc_id bigint, n_shingles bigint, digest binary, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            keys = band_keys(_matrix(part.column(1)))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)),
                                   pa.array(np.repeat(ids, BANDS))], schema=_KEYS)


def _plausible(lowest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                n_a, n_b = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                keep = jaccard_estimate(_matrix(part.column(4)), _matrix(part.column(5)), n_a, n_b) >= lowest
                kept = part.select([0, 1]).filter(pa.array(keep))
                yield pa.record_batch([kept.column(0), kept.column(1)], schema=_PAIR)
    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch, "text_a"):
                part = batch.slice(first, last - first)
                one = words_of(data, offsets)
                two = [w for _, _, more, cuts in text_chunks(part, "text_b") for w in words_of(more, cuts)]
                values, sizes = numbered_shingles(one + two, width)
                n_one, n_two = sizes[:last - first], sizes[last - first:]
                of = np.concatenate([np.repeat(np.arange(last - first), n) for n in (n_one, n_two)])
                order = np.lexsort((values, of))
                values, of = values[order], of[order]
                twice = (values[1:] == values[:-1]) & (of[1:] == of[:-1])
                common = np.bincount(of[1:][twice], minlength=last - first)
                keep = (common > 0) & (100 * common >= percent * (n_one + n_two - common))
                kept = part.select([0, 1]).filter(pa.array(keep))
                yield pa.record_batch([kept.column(0), kept.column(1)], schema=_PAIR)
    return run


def _links(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, written to the shared folder."""
    side = {c: sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"),
                               F.col("sketch").alias(f"sketch_{c}")) for c in "ab"}
    sized = pairs.join(side["a"], "a").join(side["b"], "b").where(
        # sets of too different sizes cannot reach the threshold
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = written(
        sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        .mapInArrow(tidy("minhash", _plausible(percent / 100 - MARGIN)), "a bigint, b bigint"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = texts.join(wanted, "doc_id", "left_semi")
    both = likely.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(
        tidy("minhash", _confirm(width, percent)), "a bigint, b bigint").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...).

    Documents are linked when their sets of ``width``-word shingles have a Jaccard similarity
    of at least ``percent`` / 100; component_id is the smallest doc_id reachable.  Null, empty
    and blank texts have no shingles and are linked with nothing.  A row without doc_id takes
    no part: component_id is null and it is kept.  Rows that share a doc_id are one document:
    they get one component and are all linked where one of them is.  Further columns of
    ``docs`` are not looked at.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(signatures(docs, width), "signatures")
    known = signed.where("doc_id is not null and n_shingles > 0")
    folds = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")),
                    "folds")
    reps = folds.select(F.col("rep").alias("doc_id"), "digest").distinct()
    # one row for each word sequence; the semi join looks at (id, sequence), so ids may repeat
    sketches = written(known.join(reps, ["doc_id", "digest"], "left_semi")
                       .select("doc_id", "n_shingles", "sketch"), "sketches")
    keys = sketches.select("doc_id", "sketch").mapInArrow(tidy("minhash", _bands), "key bigint, doc_id bigint")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    members = written(keys.join(shared.select("key", "lo"), "key"), "buckets")
    # later rounds only read the texts of documents that share a bucket
    texts = written(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")

    tested = written(_several(members.where("lo < doc_id").select(F.col("lo").alias("a"), F.col("doc_id").alias("b"))),
                     "pairs")
    links = _links(tested, sketches, texts, width, percent)
    labels = written(components(links), "components")
    # second round: around a member drawn by hash
    open_ = _open_buckets(members, labels)
    drawn = open_.groupBy("key").agg(F.min(F.struct(
        F.xxhash64("doc_id", "key").alias("h"), "doc_id", "component")).alias("r"))
    pairs = _untested(_several(open_.join(drawn, "key").where("component <> r.component").select(
        F.col("r.doc_id").alias("a"), F.col("doc_id").alias("b"))), tested)
    labels = _joined(labels, _links(pairs, sketches, texts, width, percent))
    tested = tested.union(pairs)
    # last round: whatever is left between components
    open_ = written(_open_buckets(members, labels), "open")
    sized = open_.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"))
    small = open_.join(sized.where(F.col("n") <= SMALL_BUCKET).select("key"), "key", "left_semi")
    one, two = (small.select("key", F.col("doc_id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    pairs = _several(one.join(two, "key").where("of_a < of_b").select("a", "b"))
    found = _links(_untested(pairs, tested), sketches, texts, width, percent)
    large = open_.join(sized.where(F.col("n") > SMALL_BUCKET).select("key", "lo"), "key")
    found = found.union(_family_links(large, sketches, texts, width, percent))
    labels = _joined(labels, found)
    # ids that occur with several word sequences tie those sequences together
    of_rep = folds.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component"))
    placed = written(signed.select("doc_id", "n_shingles", "digest").join(
        of_rep, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component")),
        "placed")
    return _tied(placed).select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def _several(pairs: DataFrame) -> DataFrame:
    """Pairs that occur in several buckets; chance seldom makes two documents meet twice.

    In the two star rounds this leaves nothing out for good: the last round sees every bucket.
    """
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").count().where(
        F.col("count") >= SHARED_BANDS).select("a", "b")


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    return written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Components after more links."""
    found = written(found, "found")
    if found.isEmpty():
        return labels
    edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return written(components(edges.union(found)), "components")


def _compare(width: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between components within a pair of blocks, one for each pair of components."""
        docs, of = group["doc_id"].to_numpy(np.int64), group["component"].to_numpy(np.int64)
        texts = pa.RecordBatch.from_pandas(group[["text"]])
        sizes, sketch = [], []
        for _, _, data, offsets in text_chunks(texts):
            shingles, n = shingle_sets(*hashed_words(data, offsets), width)
            sizes.append(n)
            sketch.append(registers(shingles, n))
        sizes, sketch = np.concatenate(sizes), np.concatenate(sketch)
        near = np.zeros((len(docs), len(docs)), bool)
        for i in range(len(docs)):
            rest = np.flatnonzero(of[i + 1:] != of[i]) + i + 1
            same = jaccard_estimate(sketch[i], sketch[rest], np.full(len(rest), sizes[i]), sizes[rest])
            near[i, rest[same >= percent / 100 - MARGIN]] = True
        wanted = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
        if not len(wanted):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        values, n = numbered_shingles([w for _, _, data, offsets in text_chunks(texts.take(pa.array(wanted)))
                                       for w in words_of(data, offsets)], width)
        row = np.repeat(np.arange(len(wanted)), n)
        _, token, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[token] > 1  # a shingle of one text is in no intersection
        column = np.cumsum(times > 1)[token[shared]] - 1
        row = row[shared]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        common = np.zeros((len(wanted), len(wanted)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            first, last = np.searchsorted(column, [low, low + 8192])
            held = np.zeros((len(wanted), 8192), np.float32)
            held[row[first:last], column[first:last] - low] = 1
            common += held @ held.T
        linked = near[np.ix_(wanted, wanted)] & (100 * common >= percent * (n[:, None] + n[None, :] - common))
        i, j = np.nonzero(linked)
        found = pd.DataFrame({"a": docs[wanted[i]], "b": docs[wanted[j]], "x": of[wanted[i]], "y": of[wanted[j]]})
        return found.drop_duplicates(["x", "y"])[["a", "b"]]
    return run


def _family_links(large: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components among the documents of large buckets (key, lo, doc_id, component).

    Documents that such buckets chain together are a family, dealt to blocks of bounded size;
    every pair of blocks is compared in memory by sketch and then on the full sets.
    """
    family = components(large.select(F.col("lo").alias("a"), F.col("doc_id").alias("b"))).select(
        F.col("node").alias("doc_id"), F.col("component").alias("family"))
    members = large.select("doc_id", "component").distinct().join(family, "doc_id").join(
        sketches.groupBy("doc_id").agg(F.sum("n_shingles").alias("n")), "doc_id")
    members = written(members, "family")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_DOCS), F.sum("n") / F.lit(BLOCK_SHINGLES)))
    placed = members.join(members.groupBy("family").agg(blocks.alias("blocks")), "family").withColumn(
        "own", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = placed.select("doc_id", "component", "family", F.least("own", "other").alias("i"),
                          F.greatest("own", "other").alias("j"))
    return dealt.join(texts, "doc_id").select("doc_id", "component", "text", "family", "i", "j").groupBy(
        "family", "i", "j").applyInPandas(_compare(width, percent), "a bigint, b bigint")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components."""
    labelled = members.select("key", "doc_id").join(
        labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    several = labelled.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return labelled.join(several, "key", "left_semi")


def _tied(placed: DataFrame) -> DataFrame:
    """Gives all rows of a repeated doc_id the smallest component that they reach."""
    several = placed.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    several = written(several, "tied")
    if several.isEmpty():
        return placed
    ties = placed.join(several.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("a"), F.col("component").alias("b"))
    joined = components(ties).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return placed.join(joined, "component", "left").withColumn(
        "component", F.coalesce("joined", "component")).drop("joined")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of linked documents the one with the smallest doc_id.

    Cases as in :func:`near_duplicates`; rows that share a doc_id stay or go together.
    """
    gone = written(near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
