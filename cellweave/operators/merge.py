"""Merging the groups of many samples by key: a full outer join of any number of tables in one shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged(samples: Mapping[str, DataFrame]) -> DataFrame:
    """All records of ``samples`` with the name of theirs in the column ``sample``; empty samples add nothing."""
    return reduce(DataFrame.unionByName, [df.withColumn("sample", F.lit(name)) for name, df in samples.items()])


def merge_records(records: DataFrame, keys: Sequence[str], order: str = "pos", sample: str = "sample") -> DataFrame:
    """(keys..., records): map of sample to the ordered array of its records with this key; a sample without any has no entry.

    Meant for molecules: the records of a key are one value. For cells of any size use
    merge_totals. Rows with a null sample are left out; null keys are a key of their own.
    """
    rest = [c for c in records.columns if c not in (*keys, order, sample)]
    own = records.where(F.col(sample).isNotNull()).groupBy(*keys, sample).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("r"))
    return own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(sample, "r"))).alias("records"))


def merge_totals(records: DataFrame, keys: Sequence[str], sample: str = "sample") -> DataFrame:
    """(keys..., totals): map of sample to (n_records, n_reads), for keys of any size.

    Records are added up by key and sample before they are shuffled.
    """
    own = records.where(F.col(sample).isNotNull()).groupBy(*keys, sample).agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_reads"))
    return own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(sample), F.struct("n_records", "n_reads")))).alias("totals"))


def in_samples(merged: DataFrame, column: str, present: Sequence[str] = (), absent: Sequence[str] = ()) -> DataFrame:
    """Semi- and anti-join of merged keys: those with an entry of all ``present`` and of none of ``absent`` samples."""
    for name in present:
        merged = merged.where(F.map_contains_key(column, F.lit(name)))
    for name in absent:
        merged = merged.where(~F.map_contains_key(column, F.lit(name)))
    return merged
