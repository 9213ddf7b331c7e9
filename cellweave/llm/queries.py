"""Queries of the operators of this package, and the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.tables import table
from . import heavy, mixing, packing, percentiles, residue, tokens

CAPACITY, PCTS, MIN_ROWS, SHARE = 4096, (50, 90, 99), 200, 0.015


def _cell_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of rows by cell and cnt, made for each sample and day and then combined."""
    bus = table(spark, d, "bus_records").select("cb", "cnt", "sample_id", F.to_date("seen_at").alias("day"))
    return percentiles.combine(percentiles.value_counts(bus, "cb", "cnt", ["sample_id", "day"]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = percentiles.percentiles(_cell_counts(spark, d), PCTS, min_rows=MIN_ROWS)
    return out.select(F.col("key").alias("cb"), F.col("pct").cast("bigint").alias("pct"), F.col("value").alias("cnt"))


def p4_sample_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of cnt of each sample, and so of groups of any size: few, and huge ones."""
    counts = percentiles.combine(percentiles.value_counts(table(spark, d, "bus_records"), "sample_id", "cnt"))
    return percentiles.percentiles(counts, PCTS).select(F.col("key").alias("sample_id"), F.col("pct").cast("bigint").alias("pct"), F.col("value").alias("cnt"))


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_hitters(table(spark, d, "bus_records").select("cb", "cnt"), "cb", "cnt", SHARE)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _heavy(spark, d).select(F.col("key").alias("cb"))


def p5_heavy_cells(spark: SparkSession, d: str) -> DataFrame:
    """The heavy cells with their reads; the bounds of the sketch must hold them."""
    h = _heavy(spark, d)
    return h.select(F.col("key").alias("cb"), F.col("weight").alias("reads"), ((F.col("lower") <= F.col("weight")) & (F.col("weight") <= F.col("upper"))).alias("in_bounds"))


def p5_narrow_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The same from a sketch of far fewer cells than there are keys, so that votes cancel in every cell."""
    own = table(spark, d, "bus_records").select("cb", "cnt")
    return heavy.heavy_hitters(own, "cb", "cnt", SHARE, rows=4, cols=256).select(F.col("key").alias("cb"), F.col("weight").alias("reads"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, d, "documents"), ["doc_id"])
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_items(_packed(spark, d)).select(F.col("item").alias("doc_id"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).drop("row").withColumnRenamed("item", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), CAPACITY)


def p6_holds(spark: SparkSession, d: str) -> DataFrame:
    """Every document is placed once, in pieces that follow one another; no container is too full; of ten containers' space less than one's is unused."""
    packed = cut(_packed(spark, d))
    whole = packed.groupBy("row").agg(F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("end"), F.max("piece").alias("last"))
    whole = whole.agg(F.count(F.lit(1)).alias("n_documents"), F.min((F.col("size") == F.col("end")) & ((F.col("last") > 0) == (F.col("size") > CAPACITY))).alias("whole"))
    fill = packing.fill_report(packed, CAPACITY)
    fill = fill.select((F.col("fullest") <= CAPACITY).alias("within"), (F.col("n_containers") <= 1.1 * F.col("fewest") + 1).alias("filled"), F.col("n_split").alias("n_exceeding"))
    both = whole.unionByName(fill, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _mixed(spark: SparkSession, d: str, hold: bool = False) -> tuple[DataFrame, DataFrame]:
    """The plan of the mix and the mix."""
    sizes = mixing.sized(tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"]))
    plan = mixing.mix_plan(sizes, table(spark, d, "mix_targets"), hold=hold)
    return plan, mixing.mix(sizes, plan, "doc_id")


def _shares(spark: SparkSession, d: str, hold: bool = False) -> DataFrame:
    plan, mixed = _mixed(spark, d, hold)
    return mixing.mix_shares(mixed, plan)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).where("not reached").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)


def p7_held_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same for a mix so small that every source with documents holds its share beside the others."""
    return _shares(spark, d, hold=True)


def p7_holds(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's part of the mix: whether it is used up, keeps to max_repeats, differs by at most one between records, and ends within a record of its budget."""
    plan, mixed = _mixed(spark, d)
    own = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n"), F.max("n_tokens").alias("longest"), F.min("copies").alias("fewest"), F.max("copies").alias("most"), F.count(F.lit(1)).alias("used"))
    out = plan.join(own, "source", "left").fillna(0, ["n", "longest", "fewest", "most", "used"])
    exhausted = F.col("n") == F.col("available") * F.col("max_repeats")
    even = (F.col("most") <= F.col("epochs") + 1) & ((F.col("epochs") == 0) | ((F.col("fewest") >= F.col("epochs")) & (F.col("used") == F.col("n_records"))))
    ends = (exhausted & (F.col("n") <= F.col("budget"))) | (F.abs(F.col("n") - F.col("budget")) <= F.col("longest"))
    return out.select("source", exhausted.alias("exhausted"), (F.col("most") <= F.col("max_repeats")).alias("repeats"), even.alias("even"), ends.alias("ends"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = residue.residue(table(spark, d, "documents"))
    return found.groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n_docs"), F.max("hosts").alias("most_hosts"))


def p8_parts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of documents with and without residue; together they are all."""
    docs = table(spark, d, "documents")
    found = cut(residue.residue(docs).select("doc_id").distinct())
    kept = residue.without_residue(docs, found).select("doc_id", F.lit(0).alias("residue"))
    both = kept.unionByName(docs.select("doc_id").join(found, "doc_id", "left_semi").select("doc_id", F.lit(1).alias("residue")))
    return both.agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("doc_id").alias("n_ids"), (F.sum("residue") > 0).alias("some"), (F.sum("residue") < 0.2 * F.count(F.lit(1))).alias("few"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return residue.without_residue(docs, residue.residue(docs)).select("doc_id", "source", "repo", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (p4_found, p4_sample_percentiles, p5_found, p5_heavy_cells, p5_narrow_sketch, p6_found, p6_containers, p6_fill, p6_holds)
    all_ += (p7_found, p7_mix, p7_shares, p7_held_shares, p7_holds, p8_found, p8_kinds, p8_parts, p8_clean)
    return {f.__name__: f for f in all_}


def _percentile_sql(key: str, having: str) -> str:
    one = "SELECT {key}, CAST({p} AS BIGINT) AS pct, quantile_disc(cnt, {q}) AS cnt FROM bus_records WHERE {key} IS NOT NULL AND cnt IS NOT NULL GROUP BY {key} {having}"
    return " UNION ALL ".join(one.format(key=key, p=p, q=p / 100, having=having) for p in PCTS)


#: SQL has no tokenizer. Pieces of words, numbers and single marks stand for tokens: no document or source lies near a limit.
_PIECES = r"len(regexp_extract_all(text, '[A-Za-z]{1,5}|[0-9]{1,2}|[^\sA-Za-z0-9]'))"
_SOURCES = f"""WITH sized AS (SELECT source, sum({_PIECES}) AS n FROM documents GROUP BY source),
 own AS (SELECT m.source, coalesce(n, 0) * max_repeats AS have, target_share * (SELECT sum(n) FROM sized) AS want FROM mix_targets m LEFT JOIN sized s ON s.source = m.source)"""


def oracle_sql() -> dict[str, str]:
    heavy_sql = f"FROM bus_records WHERE cb IS NOT NULL GROUP BY cb HAVING sum(cnt) >= {SHARE} * (SELECT sum(cnt) FROM bus_records)"
    return {
        "p4_found": _percentile_sql("cb", f"HAVING count(*) >= {MIN_ROWS}"),
        "p4_sample_percentiles": _percentile_sql("sample_id", ""),
        "p5_found": f"SELECT cb {heavy_sql}",
        "p5_heavy_cells": f"SELECT cb, CAST(sum(cnt) AS BIGINT) AS reads, true AS in_bounds {heavy_sql}",
        "p5_narrow_sketch": f"SELECT cb, CAST(sum(cnt) AS BIGINT) AS reads {heavy_sql}",
        "p6_found": f"SELECT doc_id FROM documents WHERE {_PIECES} > {CAPACITY}",
        "p6_holds": f"SELECT count(*) AS n_documents, true AS whole, true AS within, true AS filled, CAST(count(*) FILTER ({_PIECES} > {CAPACITY}) AS BIGINT) AS n_exceeding FROM documents",
        "p7_found": f"{_SOURCES} SELECT source FROM own WHERE have < want",
        "p7_holds": f"{_SOURCES} SELECT source, have < want AS exhausted, true AS repeats, true AS even, true AS ends FROM own",
        "p8_parts": "SELECT count(*) AS n_documents, count(DISTINCT doc_id) AS n_ids, true AS some, true AS few FROM documents",
    }
