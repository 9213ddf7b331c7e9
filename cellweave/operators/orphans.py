"""References to records that do not exist, or not at that time.

Parent and child keys of any number of tables are brought into one long form tagged with the
parent table, grouped by parent table and key, and what is left without a valid parent is counted
by period. Validity intervals are handled by the same grouping on slots of time. The parents
alone tell on which (key, day) and in which (key, minute) a validity starts or ends; a child row
counts in the slot of its day where nothing changes, of its minute where the day changes but the
minute does not, and of its exact time else. One scan adds the children up by key and slot before
they are shuffled, so a hot key is reduced to a row a slot before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.salting import salted_join

DAY_US, MINUTE_US = 86_400_000_000, 60_000_000


@dataclass(frozen=True)
class Parent:
    """Rows of ``df`` are valid from ``since`` (inclusive) to ``until`` (exclusive; null: still)."""

    name: str
    df: DataFrame
    key: str
    since: str
    until: str


@dataclass(frozen=True)
class Child:
    """Rows of ``df`` refer by ``key`` to ``parent``, at the time ``at``."""

    name: str
    df: DataFrame
    key: str | Column
    at: str
    parent: str


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, free of the session's time zone."""
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _bounds(parents: Sequence[Parent]) -> DataFrame:
    """(parent, key, t, delta): +1 where a validity starts, -1 where it ends."""
    parts = []
    for p in parents:
        rows = p.df.select(F.lit(p.name).alias("parent"), F.col(f"`{p.key}`").cast("bigint").alias("key"), micros(p.since).alias("a"), micros(p.until).alias("b"))
        rows = rows.where("key is not null and a is not null and (b is null or b > a)")
        both = F.explode(F.when(F.col("b").isNull(), F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("delta")))).otherwise(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("delta")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("delta")))))
        parts.append(rows.select("parent", "key", both.alias("e")).select("parent", "key", "e.t", "e.delta"))
    return reduce(DataFrame.unionByName, parts)


def _references(children: Sequence[Child]) -> DataFrame:
    """(parent, child, key, t) of every row with a non-null key."""
    parts = []
    for c in children:
        key = F.col(f"`{c.key}`") if isinstance(c.key, str) else c.key
        parts.append(c.df.select(F.lit(c.parent).alias("parent"), F.lit(c.name).alias("child"), key.cast("bigint").alias("key"), micros(c.at).alias("t")).where("key is not null"))
    return reduce(DataFrame.unionByName, parts)


def _start(grain: int) -> Column:
    """When the period of a time begins."""
    return F.expr(f"t - pmod(t, {grain})")


def _changed(bounds: DataFrame, grain: int) -> DataFrame:
    """(parent, key, start): periods in which a validity starts or ends."""
    return bounds.select("parent", "key", _start(grain).alias("start")).distinct()


def orphan_references(children: Sequence[Child], parents: Sequence[Parent]) -> DataFrame:
    """(child, parent, day, key, reason, n): n rows of ``child`` on ``day`` refer to a key no row of ``parent`` is valid for at their time.

    ``reason`` is ``missing`` (no valid row ever), ``added_later`` or ``removed``. ``day`` is a
    ``YYYY-MM-DD`` string. Null keys are no references. References at a null time have a null day
    and count as missing. Parent rows with a null start, or that end before they start, are never
    valid. Repeated child rows all count. Columns other than the named ones are ignored.
    """
    refs, bounds = _references(children), _bounds(parents)
    # what changes when: at most two rows for each parent row
    day, minute = (cut(_changed(bounds, grain)) for grain in (DAY_US, MINUTE_US))
    rows = refs
    for name, grain, changed in (("__day", DAY_US, day), ("__minute", MINUTE_US, minute)):
        rows = salted_join(rows.withColumn(name, _start(grain)), changed.withColumnRenamed("start", name).withColumn(f"{name}_changes", F.lit(True)), ["parent", "key", name], F.col("t"), changed.count(), how="left")
    slot = F.when(F.col("__day_changes").isNull(), F.col("__day")).when(F.col("__minute_changes").isNull(), F.col("__minute")).otherwise(F.col("t"))
    own = rows.groupBy("parent", "key", "child", slot.alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn("delta", F.lit(0).cast("bigint")).withColumn("changes", F.lit(0).cast("bigint"))
    edge = bounds.groupBy("parent", "key", "t").agg(F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("changes")).withColumn("child", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("bigint"))
    key = Window.partitionBy("parent", "key")
    past = key.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    long = own.unionByName(edge).withColumn("valid", F.sum("delta").over(past)).withColumn("before", F.sum("changes").over(past)).withColumn("ever", F.sum("changes").over(key))
    reason = F.when(F.col("t").isNull() | (F.col("ever") == 0), "missing").when(F.col("before") == 0, "added_later").otherwise("removed")
    out = long.where("child is not null and (t is null or valid <= 0)").withColumn("reason", reason).withColumn("day_no", F.expr(f"(t - pmod(t, {DAY_US})) div {DAY_US}"))
    out = out.groupBy("child", "parent", "day_no", "key", "reason").agg(F.sum("n").alias("n"))
    return out.select("child", "parent", F.date_format(F.date_from_unix_date(F.col("day_no").cast("int")), "yyyy-MM-dd").alias("day"), "key", "reason", "n")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(child, parent, day, reason, n_rows, n_keys) of orphan_references()."""
    return orphans.groupBy("child", "parent", "day", "reason").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
