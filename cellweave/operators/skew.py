"""Per-key results when a few keys hold most of the records.

Value-frequency compression: rows are first grouped by key *and value*, which spreads a hot key
over as many tasks as it has values and is pre-aggregated before the shuffle; everything per key
is then derived exactly from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def value_frequencies(df: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """(key, value, n[, total]): rows and, if asked for, the sum of ``weight`` of each pair.

    Null keys and null values form pairs of their own. Other columns are ignored.
    """
    cols = [F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")]
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight:
        cols.append(F.col(f"`{weight}`").cast("bigint").alias("w"))
        aggs.append(F.sum("w").alias("total"))
    return df.select(*cols).groupBy("key", "value").agg(*aggs)


def key_totals(freq: DataFrame) -> DataFrame:
    """(key, n_rows, n_distinct[, total]) from value_frequencies(); exact.

    ``n_distinct`` counts non-null values. A null key is a key of its own.
    """
    aggs = [F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct")]
    if "total" in freq.columns:
        aggs.append(F.sum("total").alias("total"))
    return freq.groupBy("key").agg(*aggs)


def key_modes(freq: DataFrame) -> DataFrame:
    """(key, mode, mode_n): the most frequent non-null value, among ties the smallest.

    Keys without a non-null value have no row.
    """
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("b")
    return freq.where("value is not null").groupBy("key").agg(best).select("key", F.col("b.value").alias("mode"), (-F.col("b.neg")).alias("mode_n"))


def key_percentiles(freq: DataFrame, pcts: Sequence[int]) -> DataFrame:
    """(key, pct, value): the smallest value with at least pct percent of rows not above it.

    Nulls do not count; keys with nothing else have no row; a null key is a key of its own. Exact.
    The weighted values of all keys are put into one order by ranges of (key, value) of equal
    numbers of rows, so a hot key lies in as many ranges as it needs and a task orders one range.
    Weights are added up within a range, and the sums of a key's ranges, a row each, before it.
    """
    rows = freq.where("value is not null").select("key", F.col("value").cast("bigint").alias("value"), "n")
    ranged = cut(rows.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("key", "part").agg(F.sum("n").alias("size"))
    # a row for each key and range it lies in
    own = Window.partitionBy("key")
    starts = sizes.withColumn("start", F.sum("size").over(own.orderBy("part")) - F.col("size")).withColumn("total", F.sum("size").over(own)).drop("size")
    run = ranged.withColumn("run", F.sum("n").over(Window.partitionBy("key", "part").orderBy("value")))
    starts = starts.select(F.col("key").alias("__key"), F.col("part").alias("__part"), "start", "total")
    upto = F.col("start") + F.col("run")
    placed = run.join(starts, F.col("key").eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part"))).withColumn("upto", upto)
    # rank = ceil(pct * total / 100) in whole numbers, at least 1
    hits = []
    for p in pcts:
        rank = F.greatest(F.lit(1), F.expr(f"({int(p)} * total + 99) div 100"))
        hits.append(F.when((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("n")), F.lit(int(p))))
    return placed.select("key", F.explode(F.array_compact(F.array(*hits))).alias("pct"), "value")
