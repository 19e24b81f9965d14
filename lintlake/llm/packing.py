"""Best-fit packing of documents into training sequences.

A sequence is a bin with three capacities: tokens, number of documents and attention cost (the
sum of squared lengths).  Pieces are placed from long to short, each into the bin that has room
in every capacity and is best by a weighted score: the largest dot product of demand and
residual capacities, or the smallest norm of what would be left.  A piece that fits nowhere
opens a bin.  Pieces are dealt by hash, or in a given order, to groups of bounded size, which
are packed independently and waste less than one sequence each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship, text_chunks, tidy, written
from .tokens import encoder, with_end

ship(__name__)

SEQUENCE_TOKENS = 4096
GROUP_PIECES = 4096
#: How much tokens, number of documents and attention count in a bin's score.
WEIGHTS = (1.0, 1.0, 1.0)
#: Bits of a sequence number that tell the bins of a group apart.
BIN_BITS = 26

_PIECES = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(tokenizer: str, spaced: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, spaced)
        for batch in batches:
            ids, groups = batch.column(0), batch.column(2)
            for first, last, data, cuts in text_chunks(batch):
                found, bounds = with_end(*tokens.encode_flat(data, cuts), end_id)
                found, bounds = found.astype("<u4"), bounds.tolist()
                rows: list[list] = [[] for _ in _PIECES]
                for group, doc, begin, end in zip(groups.slice(first, last - first).to_pylist(),
                                                  ids.slice(first, last - first).to_pylist(), bounds, bounds[1:]):
                    for piece, start in enumerate(range(begin, end, capacity)):
                        part = found[start:min(start + capacity, end)]
                        for column, value in zip(rows, (group, doc, piece, start - begin, len(part), zlib.crc32(part))):
                            column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _PIECES)], schema=_PIECES)
    return run


def token_pieces(docs: DataFrame, tokenizer: str, spaced: bool = False, end_id: int = 1,
                 capacity: int = SEQUENCE_TOKENS, group: Column | None = None) -> DataFrame:
    """group, doc_id, piece, start, length, ids_crc32: ids of each whole text and then ``end_id``, cut."""
    bounded_batches(docs.sparkSession)
    own = F.lit(None) if group is None else group
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       own.cast("bigint").alias("group")).mapInArrow(
        tidy("tokens", _cut(tokenizer, spaced, end_id, capacity)),
        "group bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def place(lengths: np.ndarray, capacity: int, documents: int, attention: float,
          weights: tuple[float, float, float], score: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths come from long to short."""
    limits = np.array([capacity, documents, attention], float)
    scale = np.array(weights, float) / limits
    left = np.zeros((3, 64))
    bins, offsets, used = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), 0
    full = int((lengths >= capacity).sum())  # these have a bin to themselves
    for i, length in enumerate(lengths[full:].tolist(), full):
        need = np.array([length, 1, float(length) ** 2])
        # a piece is never longer than a bin, so alone it always has one to itself
        fits = np.flatnonzero((left[:, :used] >= need[:, None]).all(axis=0))
        if len(fits):
            if score == "dot":
                best = fits[np.argmax((need * scale) @ (left[:, fits] * scale[:, None]))]
            else:
                best = fits[np.argmin((((left[:, fits] - need[:, None]) * scale[:, None]) ** 2).sum(axis=0))]
        else:
            if used == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
            best, used = used, used + 1
            left[:, best] = np.maximum(limits, need)
        bins[i], offsets[i] = full + best, capacity - left[0, best]
        left[:, best] -= need
    return bins, offsets


def _pack(capacity: int, documents: int, attention: float, weights, score: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = place(group["length"].to_numpy(), capacity, documents, attention, weights, score)
        return group.assign(sequence_id=(group["group"].to_numpy() << BIN_BITS) + bins, offset=offsets).drop(columns="group")
    return run


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, documents: int | None = None,
         attention: float | None = None, weights: tuple[float, float, float] = WEIGHTS,
         score: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (group, doc_id, piece, start, length, ids_crc32).

    ``documents`` and ``attention`` limit the pieces and the sum of squared lengths of a
    sequence; by default they are as wide as ``capacity`` allows.  ``score`` is "norm" or
    "dot", of the residuals as shares of their limits, by ``weights``.  A piece that alone passes
    the attention limit gets a sequence of its own.  Pieces of one ``group`` share sequences with
    each other only and sequence numbers ascend with it; those without are dealt by hash.
    """
    documents = documents or capacity
    attention = attention or float(capacity) ** 2
    pieces = written(pieces, "pieces")
    groups = max(1, -(-pieces.where("group is null").count() // group_pieces))
    dealt = pieces.withColumn("group", F.coalesce("group", F.pmod(
        F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups))))
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("group").applyInPandas(_pack(capacity, documents, attention, weights, score), kinds)


def pack_documents(docs: DataFrame, tokenizer: str, spaced: bool = False, end_id: int = 1,
                   capacity: int = SEQUENCE_TOKENS, group: Column | None = None, **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    Null and empty texts are one piece that holds only the end id.  Rows without doc_id and
    repeated rows are packed like any other row.  Texts of any length are encoded whole and
    only cut if longer than ``capacity``.  ``group`` is a column of ``docs``, as for :func:`pack`.  Further columns are not looked at; an empty table
    gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, spaced, end_id, capacity, group), capacity, **limits)


def read_order(docs: DataFrame, group_rows: int = GROUP_PIECES) -> Column | None:
    """Runs of ``group_rows`` rows as they stand in the files that ``docs`` was read from (of fewer
    than 2**18 runs each, fewer than 2**19 files); None if its rows come from elsewhere."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException as error:
        if not error.getCondition().startswith("UNRESOLVED_COLUMN"):
            raise
        return None
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
    return F.shiftleft(part, 18) + F.floor(F.col("_metadata.row_index") / group_rows)
