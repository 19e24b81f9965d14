"""Folding ordered text pieces of any group into texts of bounded size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: No folded text has more bytes.
MAX_TEXT_BYTES = 1 << 20


def fold_texts(pieces: DataFrame, *keys: str, order: Column, text: Column,
               max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """(keys, part, parts, text): the pieces of each group joined in order, ``part`` from 1.

    A group of at most ``max_bytes`` bytes is one text; a larger one is as many numbered texts as
    it needs, none larger than that, which put together are the whole. Pieces are range-sorted, so a
    group that holds most rows is spread like any other; only byte counts by range meet per group.
    Without keys everything would be one group: that raises.
    """
    if not keys:
        raise ValueError("fold_texts needs keys: without them all rows are one group")
    if max_bytes < 8:
        raise ValueError("max_bytes must be at least 8")
    half = max_bytes // 2
    step = half // 4  # a character has at most four bytes
    named = pieces.select(*keys, order.alias("_ord"), F.coalesce(text, F.lit("")).alias("_text"))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("_text") - 1) / step).cast("int")))
    cut = named.withColumn("_cut", F.explode(cuts)).withColumn(
        "_text", F.substring(F.col("_text"), F.col("_cut") * step + 1, F.lit(step)))
    # written once: the ranges are drawn from a sample and must not differ between the uses below
    placed = stored(cut.repartitionByRange(*keys, "_ord", "_cut").withColumn("_run", F.spark_partition_id()), "pieces")
    before = Window.partitionBy(*keys, "_run").orderBy("_ord", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    # pieces have at most half the bound, so no number is left out and no part passes the bound
    numbered = placed.withColumn("_bytes", F.octet_length("_text").cast("bigint")).withColumn(
        "_at", F.floor(F.coalesce(F.sum("_bytes").over(before), F.lit(0)) / half))
    runs = numbered.groupBy(*keys, "_run").agg((F.max("_at") + 1).alias("_n"), F.sum("_bytes").alias("_bytes"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_run").alias("_of"),
        (F.sum("_bytes").over(group) <= max_bytes).alias("_small"), F.sum("_n").over(group).alias("_parts"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_run") == F.col("_of"))
    parts = _joined(numbered, [*keys, "_run", "_at"], F.struct("_ord", "_cut", "_text")).join(runs, same)
    # ranges cut through small groups too: their few texts are joined once more
    return _joined(
        parts.withColumn("part", F.when(F.col("_small"), F.lit(1)).otherwise(F.col("_before") + F.col("_at") + 1)),
        [*keys, "part"], F.struct("_run", "_at", "_text"),
        F.max(F.when(F.col("_small"), 1).otherwise(F.col("_parts"))).alias("parts"),
    ).select(*keys, F.col("part").cast("bigint").alias("part"), F.col("parts").cast("bigint").alias("parts"),
             F.col("_text").alias("text"))


def _joined(rows: DataFrame, keys: list[str], piece: Column, *more: Column) -> DataFrame:
    ordered = F.sort_array(F.collect_list(piece))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda p: p["_text"]), "").alias("_text"), *more)
