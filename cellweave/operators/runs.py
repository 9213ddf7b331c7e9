"""Differences and runs of ordered columns: what block compression does, as relations.

Order is that of ``pos`` within blocks of a fixed number of positions, as in a compressed file, so
a task never orders more than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_block(bus: DataFrame, block: int, order: str = "pos") -> DataFrame:
    """``bus`` with the number of each record's block."""
    return bus.withColumn("block", F.expr(f"{order} div {block}"))


def deltas(bus: DataFrame, order: str = "pos") -> DataFrame:
    """``bus`` (with block) and d_cb, d_umi: differences to the record before.

    The first cb of a block is taken as it is. umi counts from 1, and anew from 0 where cb changes.
    """
    w = Window.partitionBy("block").orderBy(order)
    last_cb, last_umi = F.lag("cb").over(w), F.lag("umi").over(w)
    d_umi = F.when(last_cb == F.col("cb"), F.col("umi") - last_umi).otherwise(F.col("umi") + 1)
    return bus.withColumn("d_cb", F.col("cb") - F.coalesce(last_cb, F.lit(0))).withColumn("d_umi", d_umi)


def undo_deltas(rows: DataFrame, order: str = "pos") -> DataFrame:
    """``rows`` (block, pos, d_cb, d_umi) with cb and umi again."""
    w = Window.partitionBy("block").orderBy(order)
    own = rows.withColumn("cb", F.sum("d_cb").over(w))
    # where a cell begins, the difference is the umi itself, plus one
    start = F.coalesce(F.lag("cb").over(w) != F.col("cb"), F.lit(True))
    own = own.withColumn("__start", start.cast("int")).withColumn("__cell", F.sum("__start").over(w))
    return own.withColumn("umi", F.sum("d_umi").over(Window.partitionBy("block", "__cell").orderBy(order)) - 1).drop("__start", "__cell")


def runs_of(rows: DataFrame, value: str, special: int, order: str = "pos") -> DataFrame:
    """(block, first, value, length): runs of ``special``, and every other value by itself with length 1."""
    w = Window.partitionBy("block").orderBy(order)
    same = (F.col(value) == special) & (F.lag(value).over(w) == special)
    marked = rows.select("block", order, F.col(value).alias("value"), F.coalesce(~same, F.lit(True)).cast("int").alias("__new"))
    marked = marked.withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy("block", "__run").agg(F.min(order).alias("first"), F.first("value").alias("value"), F.count(F.lit(1)).alias("length")).drop("__run")


def undo_runs(runs: DataFrame) -> DataFrame:
    """(block, pos, value) of runs_of() again."""
    each = F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("i")
    return runs.select("block", "first", "value", each).select("block", (F.col("first") + F.col("i")).alias("pos"), "value")
