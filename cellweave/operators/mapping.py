"""What an equivalence class stands for: transcripts and genes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


@dataclass(frozen=True)
class Mapper:
    """What classes stand for: ``made`` is (ec, names), the names in order. Everything is made when asked for, and once."""

    made: DataFrame

    @cached_property
    def sets(self) -> DataFrame:
        """(ec, names), written once: molecules look classes up several times."""
        return cut(self.made)

    @cached_property
    def names(self) -> DataFrame:
        """(id, name) of every name that a class stands for."""
        return number_names(self.sets.select(F.explode("names").alias("name")), "name")

    @cached_property
    def classes(self) -> DataFrame:
        """(ec, ids, names), both arrays in order; ids are ranks of the names."""
        each = self.sets.select("ec", F.explode("names").alias("name")).join(self.names, "name")
        ids = each.groupBy("ec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        return self.sets.join(ids, "ec", "left").select("ec", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"), "names")

    def ids_of(self, ecs: DataFrame) -> DataFrame:
        """(ec, ids) for each row of ``ecs``; unknown classes give null."""
        return ecs.join(self.classes.select("ec", "ids"), "ec", "left")

    def names_of(self, ecs: DataFrame) -> DataFrame:
        """(ec, names) for each row of ``ecs``; unknown classes give null."""
        return ecs.join(self.sets, "ec", "left")

    def resolve(self, ids: DataFrame) -> DataFrame:
        """(id, name) for each row of ``ids``; unknown ids give null."""
        return ids.join(self.names, "id", "left")

    def listing(self) -> DataFrame:
        """All names in the order of their ids."""
        return self.names.orderBy("id")


def number_names(names: DataFrame, name: str) -> DataFrame:
    """(id, name): 0-based ranks of the distinct non-null names in byte order.

    Names are put into ranges, ordered within them, and the ranges' sizes summed up, so no task
    orders more than a range.
    """
    own = names.select(F.col(f"`{name}`").alias("name")).where("name is not null").distinct()
    ranged = cut(own.repartitionByRange("name").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # a row for each partition
    start = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return ranged.withColumn("rank", rank).join(start, "part").select((F.col("start") + F.col("rank")).cast("bigint").alias("id"), "name")


def one_line_per_class(matrix: DataFrame) -> DataFrame:
    """(ec, transcripts): of several lines of a class the last; tables without ``line_no`` have no order, there the largest array holds."""
    last = F.max(F.struct("line_no", "transcripts")) if "line_no" in matrix.columns else F.max(F.struct("transcripts"))
    return matrix.where("ec is not null").groupBy("ec").agg(last.alias("b")).select("ec", F.col("b.transcripts").alias("transcripts"))


def one_gene_per_transcript(t2g: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """(tx_name, gene). A transcript with several rows is an error, or keeps its smallest gene with ``on_duplicate="first"``."""
    n = F.count(F.lit(1))
    bad = F.raise_error(F.concat(F.lit("duplicate transcript: "), F.col("tx_name"))).cast("string")
    gene = F.min("gene") if on_duplicate == "first" else F.when(n > 1, bad).otherwise(F.min("gene"))
    return t2g.where("tx_name is not null").groupBy("tx_name").agg(gene.alias("gene"))


def _with_names(matrix: DataFrame, transcripts: DataFrame, on_missing: str) -> DataFrame:
    """(ec, tx_line, tx_name), a row for each transcript of a class; a class without any keeps one row of nulls."""
    long = one_line_per_class(matrix).select("ec", F.explode_outer("transcripts").alias("tx_line"))
    named = long.join(transcripts.select("tx_line", "tx_name"), "tx_line", "left")
    if on_missing == "error":
        bad = F.raise_error(F.concat(F.lit("unknown transcript: "), F.col("tx_line").cast("string"))).cast("string")
        named = named.withColumn("tx_name", F.when(F.col("tx_line").isNotNull() & F.col("tx_name").isNull(), bad).otherwise(F.col("tx_name")))
    return named


def _mapper(sets: DataFrame) -> Mapper:
    """From (ec, name), name null where a class has nothing."""
    return Mapper(sets.groupBy("ec").agg(F.sort_array(F.collect_set("name")).alias("names")))


def gene_mapper(matrix: DataFrame, transcripts: DataFrame, t2g: DataFrame, on_missing: str = "error", on_duplicate: str = "error") -> Mapper:
    """The genes of every class: its transcripts' genes, without repetition.

    Transcripts without a gene are passed over; a class that has none keeps an empty set. An
    unknown transcript is an error, or passed over with ``on_missing="drop"``.
    """
    named = _with_names(matrix, transcripts, on_missing)
    genes = named.join(one_gene_per_transcript(t2g, on_duplicate), "tx_name", "left")
    return _mapper(genes.select("ec", F.col("gene").alias("name")))


def transcript_mapper(matrix: DataFrame, transcripts: DataFrame, on_missing: str = "error") -> Mapper:
    """The transcripts of every class; ids are ranks of their names, not their lines."""
    return _mapper(_with_names(matrix, transcripts, on_missing).select("ec", F.col("tx_name").alias("name")))


def look_up(bus: DataFrame, classes: DataFrame, values: str, on_missing: str = "error") -> DataFrame:
    """``bus`` with the column ``values`` of ``classes`` (one row an ec).

    Records of a null or unknown ec are an error, are left out with ``on_missing="drop"``, or get
    an empty array with ``on_missing="empty"``. The classes are a dimension whose size Spark
    knows: it is broadcast if small and hash-joined, with skew handling, if not.
    """
    out = bus.join(classes.select("ec", values), "ec", "inner" if on_missing == "drop" else "left")
    if on_missing == "drop":
        return out
    kind = classes.schema[values].dataType.simpleString()
    other: Column = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col("ec").cast("string"), F.lit("null")))).cast(kind) if on_missing == "error" else F.array().cast(kind)
    return out.withColumn(values, F.when(F.col(values).isNull(), other).otherwise(F.col(values)))
