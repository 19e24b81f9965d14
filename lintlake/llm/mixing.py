"""Mixing sources to target weights with a time-varying curriculum; DataFrame operations only.

Every source has a weight and a schedule: how its weight moves over the training, as
piecewise-linear knots.  Targets come from the integrated weights: total demand is shared by
weight, no target passes ``max_repeats`` times its source, and the excess goes to the others.
Within a source, documents follow each other in a fixed pseudo-random order and are repeated
once the source is used up, so every copy of a document starts at some cumulative demand.
Inverting the source's cumulative schedule at that demand gives the training position, and
documents are range-sorted by position.

A source is cut into about sqrt(n) runs of its order, and running sums are taken within runs
and over run totals, so also a source with a third of all rows has windows of sqrt(n) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Weights repeat over the sources, ordered by code point with null last.
WEIGHTS = (3.0, 1.0, 2.0)
#: (time, factor) knots that repeat over the sources; each averages 1 over the training.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def _every(values: tuple, rank: Column) -> Column:
    """The value of a short repeating list for a rank counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(by_source: DataFrame, share: float = 1.5, max_repeats: float = 2.0,
            weights: tuple = WEIGHTS) -> DataFrame:
    """Adds rank, weight and target to one row per source (source, source_size).

    With the sources in order of limit / weight, those before some point stop at their limit
    and the others share what is left by weight.  The windows run over one row per source.
    """
    ranked = by_source.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", _every(weights, F.col("rank"))).withColumn(
        "cap", F.lit(float(max_repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", left / open_weight)
    level = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.withColumn("level", level).withColumn(
        "target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap")).select(
        "source", "source_size", "rank", "weight", "target")


def _segments(schedule: tuple) -> list[tuple[float, float, float, float, float]]:
    """(demand before, time, length, first weight, last weight) of each piece, demand in all 1."""
    pieces, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((before, float(t0), float(t1 - t0), float(w0), float(w1)))
        before += (w0 + w1) / 2 * (t1 - t0)
    return [(b / before, t, d, w0 / before, w1 / before) for b, t, d, w0, w1 in pieces]


def position(demand: Column, rank: Column, schedules: tuple = SCHEDULES) -> Column:
    """Training time at which a source's cumulative schedule reaches ``demand`` (0 to 1)."""
    result = F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        at = F.lit(None).cast("double")
        for before, time, length, w0, w1 in _segments(schedule):  # later pieces win
            rest = demand - F.lit(before)
            if w0 == w1:
                inside = F.lit(time) + rest / F.lit(w0)
            else:
                slope = (w1 - w0) / length
                inside = F.lit(time) + (F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * rest) - F.lit(w0)) / F.lit(slope)
            at = F.when(demand >= F.lit(before), inside).otherwise(at)
        result = F.when(rank % len(schedules) == i, at).otherwise(result)
    return result


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _order_key(docs: DataFrame) -> Column:
    """Fixed pseudo-random order; equal only for rows of the same id and text."""
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"),
                          F.coalesce(docs["text"].cast("string"), F.lit(""))))


def _demand(copy: int | Column = 0) -> Column:
    """Cumulative demand, as a share of the target, at which a copy of a document (from 0) starts."""
    start = (F.lit(copy) if isinstance(copy, int) else copy) * F.col("source_size") + F.col("before")
    return F.when(F.col("target") > 0, F.least(F.lit(1.0), start / F.col("target")))


def mix(docs: DataFrame, share: float = 1.5, max_repeats: float = 2.0, weights: tuple = WEIGHTS,
        schedules: tuple = SCHEDULES, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (and order_key, source) for every row.

    ``size`` counts words (null text: 0); ``taken`` are the words the mix takes of a document
    with repeats.  The takes of a source add up to its target, rounded down: its last document
    is taken in part.  With ``whole`` documents are taken as a whole or not at all, the last
    one if at least half of it is wanted.  ``position`` is the training time of the first take
    (null: not taken).  Rows come range-sorted by position, those not taken last.  A null
    source is a source of its own.  Null ids and repeated rows take part like any other row;
    documents without words have the position of their turn and take nothing.  Further columns
    are not looked at; an empty table gives an empty result.
    """
    placed = _placed(docs, share, max_repeats, weights, schedules, whole)
    sort_key = F.coalesce("position", F.lit(1.0) + F.col("turn"))
    return placed.withColumn("sort_key", sort_key).orderBy("sort_key", "order_key").select(
        "doc_id", "size", "source_size", "target", "taken", "position", "order_key", "source")


def _placed(docs: DataFrame, share: float, max_repeats: float, weights: tuple, schedules: tuple,
            whole: bool) -> DataFrame:
    """The rows of :func:`mix` in any order, with what the positions of further copies need."""
    rows = written(docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"),
        _source_key(docs["source"]).alias("key"), word_count(docs["text"]).alias("size"),
        _order_key(docs).alias("order_key")), "sizes")
    by_source = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"),
                                        F.count("*").alias("n"))
    plan = written(targets(by_source.select("source", "source_size"), share, max_repeats, weights)
                   .withColumn("key", _source_key(F.col("source"))).drop("source", "source_size")
                   .join(by_source.select("key", "source_size", "n"), "key"), "plan")
    turn = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    placed = rows.join(plan, "key").withColumn("turn", turn).withColumn(
        "run", F.floor(F.col("turn") * F.ceil(F.sqrt("n"))))
    runs = placed.groupBy("key", "run").agg(F.sum("size").alias("run_size"))
    before = runs.withColumn("run_before", F.coalesce(F.sum("run_size").over(
        Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("run_size")
    inside = Window.partitionBy("key", "run").orderBy("order_key").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.join(before, ["key", "run"]).withColumn(
        "before", F.col("run_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.floor(F.when(F.col("source_size") > 0, F.floor("target") / F.col("source_size")).otherwise(0))
    rest = F.floor("target") - passes * F.col("source_size") - F.col("before")
    last = F.when(F.lit(2) * rest >= F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(
        F.lit(0), F.least("size", rest))
    done = lined.withColumn("taken", (passes * F.col("size") + last).cast("bigint"))
    at = F.when((F.col("taken") > 0) | ((F.col("size") == 0) & (F.col("before") < F.col("target"))),
                position(_demand(), F.col("rank"), schedules))
    return done.withColumn("position", at)


def mixed_documents(docs: DataFrame, share: float = 1.5, max_repeats: float = 2.0, weights: tuple = WEIGHTS,
                    schedules: tuple = SCHEDULES) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them whole, with all their columns.

    Every copy has its own training position, that of the demand at which it starts, and rows
    come range-sorted by it.  Documents without words are taken once where their turn comes.
    Cases as in :func:`mix`.
    """
    return _copies(docs, share, max_repeats, weights, schedules).orderBy("position", "order_key", "copy").select("row.*")


def _copies(docs: DataFrame, share: float, max_repeats: float, weights: tuple, schedules: tuple) -> DataFrame:
    """row, order_key, copy (from 0) and position of every copy that the mix takes."""
    mixed = _placed(docs, share, max_repeats, weights, schedules, whole=True)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).when(
        F.col("position").isNotNull(), 1).otherwise(0).cast("int")
    # rows of the same source, id and text share their key and are told apart by a running number
    number = Window.partitionBy("order_key", "key").orderBy("before", "taken")
    takes = written(mixed.select("order_key", "key", "taken", times.alias("times"), "source_size", "before", "target",
                                 "rank"), "takes").withColumn("no", F.row_number().over(number)).where("times > 0").drop("taken")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _order_key(docs).alias("order_key"),
                       _source_key(docs["source"]).alias("key"))
    if takes.where("no > 1").isEmpty():  # every document taken has its key to itself
        taken = rows.join(takes, ["order_key", "key"])
    else:
        numbered = rows.withColumn("no", F.row_number().over(Window.partitionBy("order_key", "key").orderBy("order_key")))
        taken = numbered.join(takes, ["order_key", "key", "no"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).select(
        "row", "order_key", "copy", position(_demand(F.col("copy")), F.col("rank"), schedules).alias("position"))
