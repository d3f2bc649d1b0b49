"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by the MD5 of the id), served up to ``max_passes`` times.
A document's virtual finish time is the number of its source's tokens up to and including it, earlier passes included,
divided by the source's target; the mix is the global order by finish time, cut where the tokens before a document
reach the budget. Equal shares of virtual time are equal shares of each target, so every source ends within about one
document of its target.

Running sums are taken in two steps so that no source is one task's work. A source's shuffled order is cut into slices
(by the first digits of the hash, as many as the rows need), which are summed before the shuffle; a window within a
slice adds the sum of the earlier ones. The events of the mix are range-sorted over all tasks by their finish time;
the partitions' sums tell in which one the budget ends, and a window there finds the last place that the mix takes.

Targets share the budget by weight; none exceeds ``max_passes`` times its source's size, and the excess is shared again
by weight among the rest: sources sorted by cap over weight are filled until the next cap is out of reach.

Cases: a null text or one without words has size 0 and is never taken; a null source comes last; equal ids keep one
order (by text size, then text); a table without words takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.lookup import BROADCAST_IDS
from plumbline.llm.words import word_count
from plumbline.session import cut, release, staged

#: Rows of a slice of a source's shuffled order, about; there are 16, 256, ... slices.
SLICE = 50_000
#: The order of the mix; it ends with what tells rows of one id apart.
ORDER = ["finish", "source_rank", "turn", "shuffle", "size", "mark"]
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """Per source: source, source_rank, source_size, target (double). One row per source goes through each window."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(cycle, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy((F.col("source_size") / F.col("weight")), "source_rank")
    everything = Window.partitionBy(F.lit(1))
    filled = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("budget"),
        F.coalesce(F.sum(F.col("source_size") * max_passes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped_before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    )
    level = (F.col("budget") - F.col("capped_before")) / F.col("weight_left")
    capped = filled.withColumn("level", level).withColumn("is_capped", F.col("source_size") * max_passes <= F.col("level") * F.col("weight"))
    # The sources up to the first that stays below its cap are full; it and all after share what is left.
    final = F.min(F.when(~F.col("is_capped"), F.struct(F.col("source_size") / F.col("weight"), "source_rank", "level"))).over(everything)
    return capped.select(
        "source",
        "source_rank",
        "source_size",
        F.when(final.isNull() | (F.struct(F.col("source_size") / F.col("weight"), "source_rank", "level") < final), (F.col("source_size") * max_passes).cast("double"))
        .otherwise(final["level"] * F.col("weight"))
        .alias("target"),
    )


def _running(rows: DataFrame, group: list[str], slice_col: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """``rows`` and the running sum of ``value`` within ``group``, rows in the order (slice, order)."""
    slices = rows.groupBy(*group, slice_col).agg(F.sum(value).alias("_slice_sum"))
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    based = slices.select(*group, slice_col, F.coalesce(F.sum("_slice_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(based, [*group, slice_col]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def _queues(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, max_passes: int) -> tuple[DataFrame, dict | None]:
    """Every row with its place in its source's queue (no texts), and the last place of the mix; None if it takes nothing."""
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
        F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")).alias("shuffle"),
    )
    sized = staged(sized)
    digits = max(1, math.ceil(math.log(max(1, sized.count()) / SLICE, 16)))
    sized_slices = sized.withColumn("slice", F.conv(F.substring("shuffle", 1, digits), 16, 10).cast("long"))
    targets = cut(source_targets(sized, weights, share, max_passes))
    t = targets.select("source_rank", F.col("source").alias("_source"), "source_size", "target")
    ranked = sized_slices.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = ranked.withColumn("slice", F.coalesce("slice", F.lit(0)))
    queued = _running(ranked, ["source_rank"], "slice", ["shuffle", "size", "mark"], "size", "served")
    queued = staged(queued.drop("slice"))
    release(sized)
    passes = F.array(*[F.lit(k) for k in range(max_passes)])
    events = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select("mark", "size", "source_rank", "shuffle", F.explode(passes).alias("turn"), "served", "source_size", "target")
    finish = F.try_divide(F.col("turn") * F.col("source_size") + F.col("served"), F.col("target"))
    ordered = events.withColumn("finish", finish).select(*ORDER).repartitionByRange(*ORDER)
    ordered = staged(ordered.withColumn("part", F.spark_partition_id()))
    # The cut: the partition in which the running sum passes the budget, then its rows one by one.
    parts = ordered.groupBy("part").agg(F.sum("size").alias("total"))
    spent = parts.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = targets.agg(F.sum("source_size") * share).first()[0]
    at = None if budget is None else spent.where(F.col("before") < budget).agg(F.max(F.struct("part", "before")).alias("m")).first()["m"]
    last = None
    if at is not None:
        inside = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ahead = ordered.where(F.col("part") == at["part"]).withColumn("ahead", F.lit(at["before"]) + inside)
        last = ahead.where(F.col("ahead") < budget).agg(F.max(F.struct(*ORDER)).alias("last")).first()["last"]
    release(ordered)
    return queued, None if last is None else last.asDict()


def _is_taken(last: dict, turn: int) -> Column:
    """Whether a queued row is taken in a pass: its place is not after the last one."""
    kinds = {"finish": "double", "source_rank": "int", "turn": "int", "shuffle": "string", "size": "long", "mark": "long"}
    end = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in ORDER])
    finish = F.try_divide(turn * F.col("source_size") + F.col("served"), F.col("target"))
    place = F.struct(finish.alias("finish"), "source_rank", F.lit(turn).alias("turn"), "shuffle", "size", "mark")
    return finish.isNotNull() & (F.col("size") > 0) & (place <= end)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """Per row: id, size, source_size, target and taken (words the mix takes, repeats counted)."""
    queued, last = _queues(docs, id_col, text_col, source_col, weights, share, max_passes)
    taken = F.lit(0)
    for turn in range(max_passes if last else 0):
        taken = taken + F.when(_is_taken(last, turn), F.col("size")).otherwise(F.lit(0))
    return queued.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """``docs`` as the mix takes them: rows that it takes twice appear twice, rows that it leaves are gone.

    Each pass takes the beginning of a source's shuffled queue, so the last place taken of every source and pass tells
    for each row, where it is read, how often it stays; texts are not shuffled. Of repeated rows at that place all stay.
    """
    queued, last = _queues(docs, id_col, text_col, source_col, weights, share, max_passes)
    if last is None:
        return docs.limit(0)
    place = F.struct("shuffle", "size", "mark")
    limits = cut(queued.groupBy("source").agg(*[F.max(F.when(_is_taken(last, k), place)).alias(f"last_{k}") for k in range(max_passes)]))
    release(queued)
    if limits.count() <= BROADCAST_IDS:
        limits = F.broadcast(limits)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(source_col).alias("source"),
        F.struct(
            F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")).alias("shuffle"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
        ).alias("place"),
    )
    d, m = rows.alias("d"), limits.alias("m")
    copies = F.lit(0)
    for k in range(max_passes):
        copies = copies + F.when((F.col("place.size") > 0) & (F.col("place") <= F.col(f"m.last_{k}")), 1).otherwise(0)
    kept = d.join(m, F.col("d.source").eqNullSafe(F.col("m.source"))).select("d._doc", copies.alias("_copies")).where("_copies > 0")
    return kept.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(f"_doc.`{c}`") for c in docs.columns])
