"""Mixing sources to target shares of the total size.

Complete epochs of a source come first; what then is missing is chosen by Efraimidis-Spirakis
sampling: every record gets an exponential key divided by its quality weight, records are taken in
the order of their keys, and the prefix sum of their sizes stops at the budget (the record in which
it ends is taken if at least half of it fits). Prefix sums are
taken over key ranges first, then over the parts of the one range in which a source's budget ends,
so only the records of one such part are ordered, however large the source is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.salting import salted_join

#: Ranges of draws for each doubling; ranges in all, and parts of a range, at most.
OCTAVE, PARTS = 16, 1 << 12


def quality_weight() -> Column:
    """Characters a token stands for, 3.5 or more giving 1: hashes, numbers and broken text weigh less. Of an empty text 1."""
    return F.when(F.col("n_tokens") > 0, F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("n_text_chars") / F.col("n_tokens") / 3.5))).otherwise(1.0)


def mix_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, hold: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, n_records, available, budget, epochs, rest) of each source with a target.

    ``sizes`` has (source, n_tokens); the mix is as large as all of it, or has ``total`` tokens.
    What a source cannot give is missing in the mix, so the shares of all others rise; with
    ``hold`` the mix is made as much smaller as it must be for every source with tokens to reach
    its share beside the others. A source's budget is its share of the mix; it is read ``epochs``
    times as a whole and once more for ``rest`` tokens, at most max_repeats times in all. Of
    repeated targets of a source the one with the largest share holds; targets with a null source,
    share or max_repeats are left out.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("available"))
    goal = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    goal = goal.where("source is not null and target_share is not null and max_repeats is not null")
    goal = goal.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("b")).select("source", "b.*")
    size = F.lit(total).cast("bigint") if total is not None else sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).scalar()
    plan = goal.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("available", F.lit(0)).alias("available"), (F.col("target_share") * size).alias("want"))
    if hold:
        least = F.min(F.when((F.col("available") > 0) & (F.col("want") > 0), F.col("available") * F.col("max_repeats") / F.col("want"))).over(Window.partitionBy())  # over a row for each target
        plan = plan.withColumn("want", F.col("want") * F.least(F.lit(1.0), F.coalesce(least, F.lit(1.0))))
    plan = plan.withColumn("budget", F.floor("want"))
    plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.least(F.col("max_repeats"), F.expr("budget div available"))).otherwise(0))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0)
    # a row for each target, read several times
    return cut(plan.withColumn("rest", F.when(F.col("available") > 0, rest).otherwise(0)).drop("want"))


def mix(sizes: DataFrame, plan: DataFrame, record: str, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """(record, source, n_tokens, copies): how often each record is in the mix; those that are not have no row.

    Records without a source in the plan, and with a null source, are not in it. Repeated rows are
    records of their own. The choice depends on the record and the seed only.
    """
    u = (F.pmod(F.xxhash64(F.col(record).cast("string"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = sizes.withColumn("w", weight if weight is not None else quality_weight())
    rows = rows.select(F.col(record).alias("record"), "source", "n_tokens", (-F.log(u) / F.col("w")).alias("draw"))
    # ranges of the draws' logarithm, each with a few percent of a source, and parts of a range; draws more than
    # 128 doublings from 1, which only weights as far apart can give, lie in the first and last range, in one part
    rows = rows.withColumn("z", F.log2("draw") * OCTAVE).withColumn("at", F.floor("z")).withColumn("range", F.greatest(F.lit(-PARTS // 2), F.least(F.lit(PARTS // 2 - 1), F.col("at"))).cast("int"))
    rows = rows.withColumn("part", F.when(F.col("at") == F.col("range"), F.floor((F.col("z") - F.col("at")) * PARTS)).otherwise(0).cast("int")).drop("z", "at")
    limits = plan.select("source", "epochs", "rest", F.lit(0).cast("bigint").alias("base"))
    taken, open_, most = [], rows, plan.count() * PARTS
    for level in ("range", "part"):
        # a row for each source and range, or part of its one open range: at most PARTS of each source
        steps = open_.groupBy("source", level).agg(F.sum("n_tokens").alias("size")).join(limits, "source")
        upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy(level))
        steps = steps.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("size")).drop("size", "base")
        marked = salted_join(open_, steps, ["source", level], F.col("record"), most)
        more = F.when((F.col("rest") > 0) & (F.col("upto") <= F.col("rest")), 1).otherwise(0)
        edge = (F.col("rest") > 0) & (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
        taken.append(marked.where(~edge).select("record", "source", "n_tokens", (F.col("epochs") + more).alias("copies")))
        open_ = marked.where(edge).drop("upto")
        limits = steps.where(edge).select("source", "epochs", "rest", F.col("before").alias("base"))
        if level == "range":
            open_ = open_.drop("epochs", "rest", "before")
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "part").orderBy("draw", "record", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    last = open_.withColumn("run", run)
    taken.append(last.select("record", "source", "n_tokens", (F.col("epochs") + F.when(F.col("run") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).alias("copies")))
    return reduce(DataFrame.unionByName, taken).where("copies > 0").withColumnRenamed("record", record)


def mix_shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_records, max_copies, reached) of the mix, for every source of the plan.

    All but target_share are taken from the mix itself. A source is not ``reached`` if its tokens
    fall short of its budget though each of its records is used max_repeats times.
    """
    own = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_records"), F.max("copies").alias("max_copies"), F.sum("copies").alias("uses"))
    out = plan.select("source", "target_share", "max_repeats", "budget", F.col("n_records").alias("n_have")).join(own, "source", "left").fillna(0, ["n_tokens", "n_records", "max_copies", "uses"])
    all_ = F.sum("n_tokens").over(Window.partitionBy())  # over a row for each target
    out = out.withColumn("actual_share", F.when(all_ > 0, F.col("n_tokens") / all_).otherwise(0.0))
    out = out.withColumn("reached", (F.col("n_tokens") >= F.col("budget")) | (F.col("uses") < F.col("n_have") * F.col("max_repeats")))
    return out.select("source", "target_share", "actual_share", "n_tokens", "n_records", "max_copies", "reached")


def sized(tokens: DataFrame) -> DataFrame:
    """token_counts() computed once: narrow rows, read several times by the plan and the mix."""
    return cut(tokens)
