"""Language ID as a mixture over the languages of a document.

A language is a distribution over hashed character trigrams, learned from a bounded sample of
labelled documents.  Expectation-maximisation estimates the proportions of the languages in
every document; the set of languages that a document keeps is the one with the best penalised
likelihood, and its prediction is the largest proportion in that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix, ship, text_chunks, tidy, worker_cache, written

ship(__name__)

BINS = 1 << 14
#: Labelled documents of each language that the trigram counts are taken from, at most.
SAMPLE_PER_LANGUAGE = 2000
#: Short rows (language and its size, or a chosen document) that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Added to every trigram count.
SMOOTHING = 0.5
STEPS = 12
#: A further language has to gain this many times log(number of trigrams).
PENALTY = 1.5
#: Texts whose trigrams are counted at once: the count table is texts x bins.
COUNTED_TEXTS = 32
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Lower-cased letter for each code point below 65536, 0 for anything else."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.array([_letter(c) for c in range(1 << 16)], np.uint32)
    return cache["letters"]


def _letter(code: int) -> int:
    char = chr(code)
    return ord(char.lower()[0]) if char.isalpha() else 0


def trigram_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, text number) of every letter trigram, runs of other characters as one blank; which texts have letters."""
    n = len(offsets) - 1
    spaced = np.append(np.insert(data, offsets[:-1], 32), np.uint8(32)).astype(np.uint8)
    points = np.frombuffer(spaced.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.cumsum((spaced & 0xC0) != 0x80) - 1  # character number of each byte
    first = lead[offsets[:-1] + np.arange(n)]
    table = _letters()
    codes = table[np.minimum(points, 0xFFFF)]
    wide = np.flatnonzero(points > 0xFFFF)
    if len(wide):
        codes[wide] = [_letter(int(c)) for c in points[wide]]
    heads = np.zeros(len(codes), bool)
    heads[first] = True
    of = np.cumsum(heads) - 1
    keep = (codes > 0) | heads
    keep[1:] |= codes[:-1] > 0
    has_letters = np.bincount(of[codes > 0], minlength=n) > 0
    codes, of, heads = codes[keep].astype(U64), of[keep], heads[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has_letters
    whole = (of[2:] == of[:-2]) | (heads[2:] & (of[1:-1] == of[:-2]))
    whole[-1] |= of[-2] == of[-3]
    key = (codes[:-2] << U64(42)) | (codes[1:-1] << U64(21)) | codes[2:]
    bins = (mix(key[whole]) & U64(BINS - 1)).astype(np.int64)
    return bins, of[:-2][whole], has_letters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, last, data, offsets in text_chunks(batch):
            bins, of, _ = trigram_bins(data, offsets)
            names = langs[first:last]
            for lang in set(names):
                own = np.array([x == lang for x in names])
                totals.setdefault(lang, np.zeros(BINS, np.int64))
                totals[lang] += np.bincount(bins[own[of]], minlength=BINS)
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int64)),
                               pa.array(counts[used])], names=["lang", "bin", "n"])


def _small(rows: DataFrame) -> DataFrame:
    """Written, and broadcast where there are few of these short rows; else joined by a shuffle."""
    rows = written(rows, "small")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram probabilities (bins x languages).

    Takes the ``per_language`` documents of each language that come first by hash of doc_id;
    what reaches the driver is at most one number for each language and bin.
    """
    known = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang").withColumn(
        "h", F.xxhash64("doc_id"))
    sizes = _small(known.groupBy("lang").agg(F.count("*").alias("size")))
    # the hash leaves about twice the documents wanted of each language, then their ranks decide
    near = known.join(sizes, "lang").where(
        F.pmod("h", F.lit(1 << 20)) * F.col("size") < F.lit(float(1 << 20) * 2 * per_language))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "doc_id"))
    chosen = _small(near.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang").distinct())
    rows = labelled.select("text", "lang", "doc_id").join(chosen, ["doc_id", "lang"]).select("text", "lang")
    counts = rows.mapInArrow(tidy("language", _count), "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(
        F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((BINS, len(langs)), SMOOTHING)
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[own["bin"].to_numpy(np.int64), i] += own["n"].to_numpy(float)
    return langs, (table / table.sum(axis=0)).astype(np.float32)


def _expect(p: np.ndarray, counts: np.ndarray, starts: np.ndarray, of: np.ndarray, share: np.ndarray,
            steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``steps`` of expectation-maximisation, and their log likelihood, by text."""
    total = np.add.reduceat(counts, starts)
    for _ in range(steps):
        weighed = p * share[of]
        weighed *= (counts / weighed.sum(axis=1))[:, None]
        share = np.add.reduceat(weighed, starts, axis=0) / total[:, None]
    fit = np.log((p * share[of]).sum(axis=1)) * counts
    return share, np.add.reduceat(fit, starts)


def _cells(bins: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """text number * BINS + bin of the cells that are not empty, and their counts; ``of`` ascends."""
    used, counts = [], []
    for first in range(0, n, COUNTED_TEXTS):
        a, b = np.searchsorted(of, [first, first + COUNTED_TEXTS])
        cells = np.bincount((of[a:b] - first) * BINS + bins[a:b])
        own = np.flatnonzero(cells)
        used.append(own + first * BINS)
        counts.append(cells[own])
    return np.concatenate(used or [bins]), np.concatenate(counts or [bins])


def mixture(bins: np.ndarray, of: np.ndarray, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (texts x languages), zero outside of the selected set and for texts without trigrams.

    With them each text's log likelihood under its selected set, and its number of trigrams.
    """
    languages = table.shape[1]
    shares, fits, totals = np.zeros((n, languages), np.float32), np.zeros(n), np.zeros(n)
    used, counts = _cells(bins, of, n)
    if not len(used) or not languages:
        return shares, fits, totals
    counts, of, p = counts.astype(np.float32), used // BINS, table[used % BINS]
    present, starts, of = np.unique(of, return_index=True, return_inverse=True)
    total = np.add.reduceat(counts, starts)
    full, fit = _expect(p, counts, starts, of, np.full((len(present), languages), 1 / languages, np.float32), STEPS)
    single = np.add.reduceat(np.log(p) * counts[:, None], starts, axis=0)
    best = single.argmax(axis=1)
    price = PENALTY * np.log(np.maximum(total, 2))
    chosen_fit = single[np.arange(len(present)), best].astype(float)
    score = chosen_fit - price
    chosen = np.eye(languages, dtype=np.float32)[best]
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, languages + 1):
        # no set can fit better than the mixture of all, so most texts need no second look
        more = fit - size * price > score
        rows = np.flatnonzero(more)
        if not len(rows):
            break
        member = np.zeros((len(rows), languages), np.float32)
        np.put_along_axis(member, order[rows, :size], 1, axis=1)
        part = more[of]
        own = np.cumsum(more)[of[part]] - 1
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        start = full[rows] * member + 1e-3 * member
        share, fit_part = _expect(p[part], counts[part], begin, own, start / start.sum(axis=1)[:, None], STEPS)
        better = fit_part - size * price[rows] > score[rows]
        score[rows[better]] = (fit_part - size * price[rows])[better]
        chosen[rows[better]], chosen_fit[rows[better]] = share[better], fit_part[better]
    shares[present], fits[present], totals[present] = chosen, chosen_fit, total
    return shares, fits, totals


def well_fitted(shares: np.ndarray, fits: np.ndarray, totals: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts whose trigrams are at least as near to what their languages lead one to expect as to arbitrary ones.

    Each proportion is expected to be as likely as texts of its language are, arbitrary trigrams
    as the mean over all bins; a text is below the middle of both only by more than chance.
    """
    logs = np.log(table.astype(float))
    own, arbitrary = (table * logs).sum(axis=0), logs.mean(axis=0)
    expected = (shares * (own + np.log(np.maximum(shares, 1e-9)))).sum(axis=1)
    middle = (expected + (shares * (arbitrary + np.log(np.maximum(shares, 1e-9)))).sum(axis=1)) / 2
    return fits >= totals * middle - PENALTY * np.log(np.maximum(totals, 2))


def _predict(langs: list[str], model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            names, scores, fitted = [], [], []
            # fewer texts at once where texts are short
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                for first, last, data, offsets in text_chunks(part):
                    bins, of, lettered = trigram_bins(data, offsets)
                    shares, fits, totals = mixture(bins, of, last - first, table)
                    fitted += well_fitted(shares, fits, totals, table).tolist()
                    top = shares.argmax(axis=1) if langs else np.zeros(last - first, int)
                    for i, t in enumerate(top.tolist()):
                        known = bool(langs) and lettered[i]
                        names.append(langs[t] if known else UNKNOWN)
                        scores.append(min(1.0, max(0.0, float(shares[i, t]))) if known else 0.0)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                   pa.array(fitted, pa.bool_())], names=["row", "lang_pred", "score", "fitted"])
    return run


def in_held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; false without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, row: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """row, lang_pred, score, fitted for every row of ``docs``; ``row`` may be any column of it.

    Learns from text and lang of documents outside of the held-out part; predicts from the
    text alone.  Null, empty and letterless texts are ``und`` with score 0, as is everything
    where no document has a label.  Ties between languages go to the first by name.  Rows
    without doc_id are predicted but not learned from, repeated rows are predicted alike.
    Further columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = docs["text"].cast("string")
    labelled = docs.where(~in_held_out(docs["doc_id"])).select(
        docs["doc_id"], text.alias("text"), docs["lang"].cast("string").alias("lang"))
    langs, table = learn(labelled, per_language)
    rows = docs.select(row.alias("row"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(tidy("language", _predict(langs, spark.sparkContext.broadcast(table))),
                           f"row {kind}, lang_pred string, score double, fitted boolean")


def predict_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; cases as in :func:`identify`."""
    found = identify(docs, docs["doc_id"].cast("bigint"), per_language)
    return found.select(F.col("row").alias("doc_id"), in_held_out(F.col("row")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` in one or several of the learned languages; those without a letter or a fit to any go."""
    found = identify(docs, F.struct(*[docs[c] for c in docs.columns]), per_language)
    return found.where((F.col("lang_pred") != UNKNOWN) & F.col("fitted")).select("row.*")
