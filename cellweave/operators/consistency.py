"""Which gene or transcript the records of a molecule agree on.

A class names a set; the sets of a molecule's records are intersected (find_consistent), or
records are put together as long as their sets overlap (overlap_classes, which depends on order).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from .mapping import look_up

SINGLE, MULTI, NONE = "SingleGene", "Multimapped", "Inconsistent"


def intersection(sets: Column) -> Column:
    """What all arrays of an array have in common."""
    return F.aggregate(F.slice(sets, 2, F.greatest(F.size(sets), F.lit(1))), F.get(sets, F.lit(0)), lambda a, s: F.array_intersect(a, s))


def _agreed(bus: DataFrame, classes: DataFrame, values: str, keys: Sequence[str], on_missing: str) -> DataFrame:
    """(keys..., n_records, reads, status, genes); reads is null where ``bus`` has no cnt."""
    reads = F.col("cnt").cast("bigint") if "cnt" in bus.columns else F.lit(None).cast("bigint")
    known = bus.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, "ec", reads.alias("c"))
    once = known.groupBy(*keys, "ec").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"))
    # only the existence of a class is looked up before molecules are put together, not its set
    once = look_up(once, classes.select("ec", F.array(F.lit(True)).alias("there")), "there", on_missing).where(F.size("there") >= 0).drop("there")
    own = once.groupBy(*keys).agg(F.sum("n").alias("n_records"), F.sum("c").alias("reads"), F.collect_list(F.coalesce("ec", F.lit(-1))).alias("ecs"))
    sets = classes.select(F.col("ec").alias("__ec"), F.col(values).alias("__set"))
    empty = F.array().cast(classes.schema[values].dataType)
    # most molecules have one class, whose set is theirs
    one = own.where("size(ecs) = 1").withColumn("__ec", F.col("ecs")[0]).join(sets, "__ec", "left").select(*keys, "n_records", "reads", F.coalesce("__set", empty).alias("genes"))
    many = own.where("size(ecs) > 1").select(*keys, "n_records", "reads", F.explode("ecs").alias("__ec")).join(sets, "__ec", "left")
    many = many.groupBy(*keys, "n_records", "reads").agg(F.collect_list(F.coalesce("__set", empty)).alias("sets")).select(*keys, "n_records", "reads", intersection(F.col("sets")).alias("genes"))
    status = F.when(F.size("genes") == 1, SINGLE).when((F.size("genes") == 0) & (F.col("n_records") > 1), NONE).otherwise(MULTI)
    return one.unionByName(many).select(*keys, "n_records", "reads", status.alias("status"), "genes")


def find_consistent(bus: DataFrame, classes: DataFrame, values: str = "ids", keys: Sequence[str] = ("cb", "umi"), on_missing: str = "error") -> DataFrame:
    """(keys..., n_records, status, genes) of each molecule with non-null keys.

    ``genes`` is the intersection, in order, as the sets of ``classes`` are. ``status`` is
    SingleGene if it has one element, Inconsistent if it has none and there are several records,
    else Multimapped; so a single record with an empty set is Multimapped. Records are first
    reduced to the distinct classes of a molecule, before the shuffle, so what is put together is
    bounded by the number of classes.
    """
    return _agreed(bus, classes, values, keys, on_missing).drop("reads")


def cell_gene_counts(consistent: DataFrame, cell: str = "cb") -> DataFrame:
    """(cell, gene, n_molecules): molecules that stand for one gene, by cell and gene."""
    one = consistent.where(F.col("status") == SINGLE).select(cell, F.get("genes", F.lit(0)).alias("gene"))
    return one.groupBy(cell, "gene").agg(F.count(F.lit(1)).alias("n_molecules"))


class Intersector:
    """Records added one by one to the first class they overlap.

    The class a record joins shrinks to what they share and moves to the end; a record that
    overlaps none becomes a class of its own.
    """

    def __init__(self) -> None:
        self.classes: list[tuple[frozenset, int]] = []

    def add(self, s: frozenset, count: int) -> None:
        for i, (k, c) in enumerate(self.classes):
            if not k.isdisjoint(s):
                del self.classes[i]
                self.classes.append((k & s, c + count))
                return
        self.classes.append((s, count))


def _streamed(batches: Iterator[pa.RecordBatch], n_keys: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Folds records that come in order of keys and pos; holds the classes of one molecule at a time."""
    key, own = None, Intersector()

    def rows(key: tuple, own: Intersector) -> list[tuple]:
        return [(*key, sorted(k), c) for k, c in own.classes]

    for b in batches:
        out: list[tuple] = []
        for *k, _, cnt, s in zip(*(c.to_pylist() for c in b.columns)):
            if tuple(k) != key:
                if key is not None:
                    out += rows(key, own)
                key, own = tuple(k), Intersector()
            own.add(frozenset(s), cnt)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if key is not None and (out := rows(key, own)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def overlap_classes(bus: DataFrame, classes: DataFrame, values: str = "names", keys: Sequence[str] = ("cb", "umi"), order: str = "pos", on_missing: str = "error") -> DataFrame:
    """(keys..., geneset, cnt): the classes the records of each molecule form, with the sum of their counts.

    Depends on the order of records, given by ``order``; equal ones are taken by count. Null counts
    add 0. Records with an empty set form classes of their own. Where all records of a molecule are
    of one non-empty class they are that class, in any order, and are added up before the shuffle.
    The records of other molecules are folded as a stream, a molecule in one task, as the order
    demands, without being held in memory.
    """
    known = bus.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, "ec", order, F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("c"))
    known = look_up(known, classes.select("ec", F.array(F.size(values) == 0).alias("bare")), "bare", on_missing).withColumn("bare", F.coalesce(F.get("bare", F.lit(0)), F.lit(True)))
    ec = F.coalesce("ec", F.lit(-1))
    per = known.groupBy(*keys).agg(F.min(ec).alias("a"), F.max(ec).alias("b"), F.max("bare").alias("bare"), F.sum("c").alias("cnt"))
    plain = (F.col("a") == F.col("b")) & ~F.col("bare")
    sets = classes.select(F.col("ec").alias("a"), F.col(values).alias("geneset"))
    out = per.where(plain).join(sets, "a").select(*keys, "geneset", "cnt")
    rest = look_up(known.drop("bare").join(per.where(~plain).select(*keys), list(keys), "left_semi"), classes, values, "empty" if on_missing == "empty" else "drop")
    rest = rest.select(*keys, F.col(order).alias("p"), "c", F.col(values).alias("s")).repartition(*keys).sortWithinPartitions(*keys, "p", "c")
    spark_schema = T.StructType([*[bus.schema[k] for k in keys], T.StructField("geneset", classes.schema[values].dataType), T.StructField("cnt", T.LongType())])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in spark_schema])
    n = len(keys)
    return out.unionByName(rest.mapInArrow(lambda it: _streamed(it, n, arrow), spark_schema))


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[t]


def count_molecules(bus: DataFrame, classes: DataFrame, mode: str = "gene", inconsistent: str = "ignore", on_missing: str = "error") -> DataFrame:
    """(cb, umi, label, cnt): molecules with what identifies them, and their reads.

    ``mode`` ``ec``: each class of a molecule counts by itself. ``gene`` and ``transcript``: the set
    its records agree on, ``classes`` being of that kind; molecules whose records agree on nothing
    are left out (``inconsistent="ignore"``), counted as the distinct overlap classes of their
    records (``distinct``), or as one with an empty label (``single``). Labels are names joined by
    commas.
    """
    if mode == "ec":
        known = bus.where("cb is not null and umi is not null and ec is not null")
        return known.groupBy("cb", "umi", F.col("ec").cast("string").alias("label")).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"))
    agreed = _agreed(bus, classes, "names", ("cb", "umi"), on_missing)
    if inconsistent == "distinct":  # read twice below
        agreed = cut(agreed)
    named = agreed.select("cb", "umi", "status", F.array_join("genes", ",").alias("label"), F.coalesce("reads", F.lit(0)).alias("cnt"))
    good = named.where(F.col("status") != NONE).select("cb", "umi", "label", "cnt")
    if inconsistent == "ignore":
        return good
    if inconsistent == "single":
        return named.select("cb", "umi", "label", "cnt")
    split = overlap_classes(bus.join(agreed.where(F.col("status") == NONE).select("cb", "umi"), ["cb", "umi"], "left_semi"), classes, "names", on_missing=on_missing)
    return good.unionByName(split.select("cb", "umi", F.array_join("geneset", ",").alias("label"), "cnt"))
