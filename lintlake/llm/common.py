"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import importlib
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir

U64 = np.uint64
#: Characters handled together by the vectorised text code: bounds its temporaries.
CHUNK_BYTES = 1 << 20


def ship(*names: str) -> None:
    """Functions of these modules travel to executors by value, which need not have the package."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules.get(name) or importlib.import_module(name))


ship(__name__)


#: Arrow batches are cut by bytes as well as rows: texts and joined pairs of texts can be long.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, unless the session already does."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the folder that all executors share."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_driver(spark: SparkSession) -> None:
    """Lets the driver's heap shrink to what is used, and Spark drop shuffle files and broadcasts of finished steps.

    For loops of many small jobs: left alone, the heap grows with their garbage to all that it may take.
    """
    gc.collect()
    spark._jvm.System.gc()


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets from 0) of runs of whole texts.

    A run holds at most ``limit`` bytes unless one text alone is longer; null counts as empty.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased, split at ASCII blanks) and word counts by text.

    A word's hash is a scrambled sum of scrambled (place, byte) pairs: no two words collide by
    construction.  Equality that decides a result is checked on :func:`numbered_words`.
    """
    n = len(data)
    low = _LOWER[data]
    solid = ~_SPACE[low]
    edge = np.zeros(n + 1, bool)  # a text begins or ends here
    edge[offsets] = True
    blank = np.append(~solid, True)
    starts = np.flatnonzero(solid & (edge[:n] | blank[np.arange(n) - 1]))
    ends = np.flatnonzero(solid & (edge[1:] | blank[1:]))
    # bytes from the first of their word, 256 apart; blanks count on, they are in no sum
    place = np.arange(n, dtype=np.int64)
    if len(starts):
        place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, n)))
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix((place.astype(U64) << U64(8)) + low + U64(1)), out=sums[1:])
    words = mix(sums[ends + 1] - sums[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    return words, counts


def words_of(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """The words themselves (A-Z lower-cased, split at ASCII blanks), text by text."""
    return [data[a:b].tobytes().lower().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def numbered_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word, equal exactly for equal words of ``texts``, and word counts by text."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum())), counts


def numbered_shingles(texts: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`shingle_sets`, with numbers that are equal exactly for equal shingles of ``texts``."""
    words, counts = numbered_words(texts)
    lasts = np.cumsum(counts)
    of = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    keep = (at + width <= lasts[of]) | ((at == (lasts - counts)[of]) & (counts[of] < width))
    at, of = at[keep], of[keep]
    acc, kinds = words[at], int(words.max()) + 2 if len(words) else 2
    for j in range(1, width):
        inside = at + j < lasts[of]
        step = np.zeros(len(at), np.int64)  # 0: the text has no such word
        step[inside] = words[at[inside] + j] + 1
        acc = np.unique(acc * kinds + step, return_inverse=True)[1]
    order = np.lexsort((acc, of))
    acc, of = acc[order], of[order]
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (of[1:] != of[:-1])
    return acc[first], np.bincount(of[first], minlength=len(counts))


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles, text after text, and set sizes by text.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    lasts = np.cumsum(counts)
    firsts = lasts - counts
    of = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    keep = (at + width <= lasts[of]) | ((at == firsts[of]) & (counts[of] < width))
    at, of = at[keep], of[keep]
    acc = np.zeros(len(at), U64)
    for j in range(width):
        inside = at + j < lasts[of]
        acc[inside] = mix(acc[inside] * U64(0xD6E8FEB86659FD93) + words[at[inside] + j])
    sizes = np.bincount(of, minlength=len(counts))
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        if b - a > 1:
            acc[a:b].sort()
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (of[1:] != of[:-1])
    return acc[first], np.bincount(of[first], minlength=len(counts))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for models that are costly to load."""
    holder = sys.modules.setdefault("_lintlake_worker_cache", type(sys)("_lintlake_worker_cache"))
    return holder.__dict__.setdefault("entries", {})


def tidy(operator: str, run: Callable) -> Callable:
    """``run`` for mapInArrow, in workers that hold little between tasks.

    Spark keeps idle workers for later tasks of any operator, so they count beside whatever the
    executor does meanwhile: models of other operators go when a task begins, and what was
    allocated for its batches goes back to the system when it ends.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("operator") != operator:
            cache.clear()
            cache["operator"] = operator
            gc.collect()
            _give_back()
        yield from run(batches)
        _give_back()
    return task


def _give_back() -> None:
    """Returns free memory of Arrow and, where the C library can, of numpy and Python."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
