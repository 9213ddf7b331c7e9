"""Exact percentiles per group over billions of values, from results that can be combined.

The intermediate result is the number of rows of each (key, value), of any part of the data; those
of several samples and days are combined by adding up. Percentiles come from them by distributed
multi-select: a group's values are spread over parts, every part proposes its local median, the
weighted median of the proposals becomes the pivot, weights below, at and above it are counted,
the ranges that hold no wanted rank are discarded, and so on for all groups and ranges at once
until every percentile has been a pivot. All percentiles of a group share its pivots: a range that
holds several ranks is split for all of them, and a value belongs to one range only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, release
from ..plans.salting import salted_join


def parts_of(left: Column) -> Column:
    """Parts for ``left`` distinct values: as many as a part then has values, so neither those of a part nor the proposals are ever more than about the root."""
    return F.ceil(F.sqrt(left.cast("double"))).cast("bigint")


def value_counts(df: DataFrame, key: str, value: str, by: Sequence[str | Column] = ()) -> DataFrame:
    """(key, value, by..., n) of rows with a non-null key and value: the intermediate result, here of each combination of ``by``."""
    cols = [F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").cast("bigint").alias("value"), *[F.col(f"`{c}`") if isinstance(c, str) else c for c in by]]
    rows = df.select(*cols).where("key is not null and value is not null")
    return rows.groupBy(*[f"`{c}`" for c in rows.columns]).agg(F.count(F.lit(1)).alias("n"))


def combine(*counts: DataFrame) -> DataFrame:
    """(key, value, n): intermediate results of any parts of the data, added up."""
    return reduce(DataFrame.unionByName, [c.select("key", "value", "n") for c in counts]).groupBy("key", "value").agg(F.sum("n").alias("n"))


def _weighted_median(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., value, weight): the lower median of each group's values weighted by n, and their whole weight."""
    own = Window.partitionBy(*by)
    run = rows.withColumn("__upto", F.sum("n").over(own.orderBy(value))).withColumn("__all", F.sum("n").over(own))
    return run.where("2 * __upto >= __all and 2 * (__upto - n) < __all").select(*by, value, F.col("__all").alias("weight"))


def percentiles(counts: DataFrame, pcts: Sequence[int], min_rows: int = 1, salts: int = 16) -> DataFrame:
    """(key, pct, value): for each key with at least ``min_rows`` rows the smallest value such that at least pct percent of the rows are not above it.

    ``counts`` is the result of combine(). Exact: the error in rank is 0. Every percentile is found
    as a pivot, in groups of any size; what is put in order are the values of a part and the
    proposals of a range, both about the root of the range's distinct values. Each round takes at
    least a quarter of the weight from every open range, half of it as a rule. Keys and values are
    not null; an empty table gives no rows.
    """
    counts = cut(counts)
    wanted = F.array(*[F.struct(F.lit(int(p)).alias("pct"), F.greatest(F.lit(1), F.expr(f"({int(p)} * total + 99) div 100")).alias("rank")) for p in sorted(set(pcts))])
    sizes = counts.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("left")).where(F.col("total") >= min_rows)
    # a range is named by the least of the percentiles it holds; ranks count within the range
    ranges = cut(sizes.select("key", F.lit(int(min(pcts))).alias("seg"), "left", wanted.alias("ranks")))
    open_ = ranges.count()
    rows = cut(salted_join(counts, ranges.drop("ranks"), ["key"], F.col("value"), open_, salts))
    release(counts)
    found = []
    while open_:
        part = F.pmod(F.xxhash64("value"), parts_of(F.col("left")))
        medians = _weighted_median(rows.select("key", "seg", part.alias("part"), "value", "n"), ["key", "seg", "part"], "value")
        proposals = medians.groupBy("key", "seg", F.col("value").alias("pivot")).agg(F.sum("weight").alias("n"))
        pivots = _weighted_median(proposals, ["key", "seg"], "pivot").drop("weight").join(ranges.select("key", "seg", "ranks"), ["key", "seg"])
        three = salted_join(rows, pivots, ["key", "seg"], F.col("value"), open_, salts)
        below, above = F.col("value") < F.col("pivot"), F.col("value") > F.col("pivot")
        three = three.groupBy("key", "seg", "pivot").agg(
            F.first("ranks").alias("ranks"),
            F.sum(F.when(below, F.col("n")).otherwise(0)).alias("less"), F.sum(F.when(below | above, 0).otherwise(F.col("n"))).alias("equal"),
            F.sum(below.cast("bigint")).alias("n_less"), F.sum(above.cast("bigint")).alias("n_more"),
        )
        upto = F.col("less") + F.col("equal")
        split = cut(
            three.withColumn("hit", F.filter("ranks", lambda r: (r["rank"] > F.col("less")) & (r["rank"] <= upto)))
            .withColumn("low", F.filter("ranks", lambda r: r["rank"] <= F.col("less")))
            .withColumn("high", F.transform(F.filter("ranks", lambda r: r["rank"] > upto), lambda r: F.struct(r["pct"].alias("pct"), (r["rank"] - upto).alias("rank"))))
        )
        found.append(split.select("key", F.explode("hit.pct").alias("pct"), F.col("pivot").alias("value")))
        sides = split.where("size(low) + size(high) > 0").select("key", "seg", "pivot", "n_less", "n_more", F.get("low", F.lit(0))["pct"].alias("low"), F.get("high", F.lit(0))["pct"].alias("high"))
        kept = salted_join(rows.select("key", "seg", "value", "n"), sides, ["key", "seg"], F.col("value"), open_, salts)
        down = F.col("value") < F.col("pivot")
        kept = kept.select("key", F.when(down, F.col("low")).when(F.col("value") > F.col("pivot"), F.col("high")).alias("seg"), "value", "n", F.when(down, F.col("n_less")).otherwise(F.col("n_more")).alias("left"))
        last, rows = rows, cut(kept.where("seg is not null"))
        release(last)
        ranges = split.select("key", F.explode(F.array("low", "high")).alias("ranks")).where("size(ranks) > 0").select("key", F.col("ranks")[0]["pct"].alias("seg"), "ranks")
        open_ = ranges.count()
    release(rows)
    if not found:
        return counts.sparkSession.createDataFrame([], f"key {counts.schema['key'].dataType.simpleString()}, pct int, value bigint")
    return reduce(DataFrame.unionByName, found)
