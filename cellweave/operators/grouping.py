"""Cells and molecules: groups of records by cb, and by cb and umi.

Tables have the columns cb, umi, ec, cnt, flag and pos, the place of a record in its file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_totals(bus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n_records, n_reads): pre-aggregated before the shuffle, so hot groups cost a row a task.

    Null keys are a group of their own; null counts add nothing.
    """
    return bus.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_reads"))


def group_records(bus: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """(keys..., records): the group's other columns as structs, in the order of ``order``.

    The group is one value and must fit in memory: meant for molecules and small cells. Use
    group_totals or group_pages for cells of any size.
    """
    rest = [c for c in bus.columns if c not in (*keys, order)]
    return bus.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("records"))


def group_pages(bus: DataFrame, keys: Sequence[str], page_rows: int = 10_000, order: str = "pos", span: int = 1 << 20) -> DataFrame:
    """(keys..., page, records): as group_records, but groups of any size, in pages.

    A group is cut into ranges of ``span`` positions, and each range into pages of at most
    ``page_rows`` records, so no task holds more of a group than one range. Pages are in order.
    """
    rest = [c for c in bus.columns if c not in (*keys, order)]
    ranged = bus.withColumn("__range", F.expr(f"{order} div {span}"))
    n = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(order)) - 1
    pages = span // page_rows + 1  # of a range, at most
    paged = ranged.withColumn("__n", n).withColumn("page", F.expr(f"__range * {pages} + __n div {page_rows}"))
    return paged.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("records"))


def n_cells(bus: DataFrame) -> DataFrame:
    """(n_cells): distinct non-null cb; one row."""
    return bus.select("cb").distinct().agg(F.count("cb").alias("n_cells"))


def n_molecules(bus: DataFrame) -> DataFrame:
    """(n_molecules): distinct pairs of non-null cb and umi; one row."""
    return bus.where("cb is not null and umi is not null").select("cb", "umi").distinct().agg(F.count(F.lit(1)).alias("n_molecules"))


def _before(rows: DataFrame, keys: Sequence[str], order: str, span: int) -> DataFrame:
    """``rows`` with __prior, the keys of the record before in ``order``; null for the first.

    Records are compared within ranges of ``span`` positions, the last records of ranges within
    ranges of ranges, and only those of the latter, a row for ``span`` squared positions, in one task.
    """
    own = rows.withColumn("__at", F.expr(f"{order} div {span}"))
    own = own.withColumn("__prior", F.lag(F.struct(*keys)).over(Window.partitionBy("__at").orderBy(order)))
    ends = own.groupBy("__at").agg(F.max_by(F.struct(*keys), order).alias("__end")).withColumn("__up", F.expr(f"__at div {span}"))
    inner = ends.withColumn("__k", F.lag("__end").over(Window.partitionBy("__up").orderBy("__at")))
    tops = ends.groupBy("__up").agg(F.max_by("__end", "__at").alias("__end"))
    tops = tops.select("__up", F.lag("__end").over(Window.orderBy("__up")).alias("__far"))
    known = inner.join(tops, "__up", "left").select("__at", F.coalesce("__k", "__far").alias("__known"))
    return own.join(known, "__at", "left").withColumn("__prior", F.coalesce("__prior", "__known")).drop("__at", "__known")


def order_faults(bus: DataFrame, keys: Sequence[str], order: str = "pos", span: int = 1 << 20) -> DataFrame:
    """(order, keys..., prior) of each record whose keys are below those of the record before it; ``prior`` is a struct of those. Null keys come first."""
    return _before(bus.select(order, *keys), keys, order, span).where(F.col("__prior") > F.struct(*keys)).withColumnRenamed("__prior", "prior")


def check_sorted(bus: DataFrame, keys: Sequence[str], order: str = "pos", span: int = 1 << 20) -> DataFrame:
    """``bus`` unchanged, or an error ``Unsorted busfile: a -> b`` where the keys fall from one record to the next."""

    def said(of: str) -> Column:
        text = F.concat_ws(", ", *[F.col(f"{of}{k}").cast("string") for k in keys])
        return F.concat(F.lit("("), text, F.lit(")")) if len(keys) > 1 else text

    own = _before(bus, keys, order, span)
    bad = F.raise_error(F.concat(F.lit("Unsorted busfile: "), said("__prior."), F.lit(" -> "), said("")))
    return own.withColumn(order, F.when(F.col("__prior") > F.struct(*keys), bad.cast("bigint")).otherwise(F.col(order))).select(*bus.columns)


def head_records(bus: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first ``n`` records in file order: a limit is the feature here."""
    return bus.orderBy(order).limit(n)


def stride_records(bus: DataFrame, step: int, order: str = "pos") -> DataFrame:
    """Every ``step``-th record of a file, from the first on."""
    return bus.where(F.pmod(F.col(order), F.lit(step)) == 0)
