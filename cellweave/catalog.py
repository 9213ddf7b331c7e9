"""Queries of the core operators, and the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import eav, orphans, skew
from .plans.tables import table

PCTS = (50, 90, 99)


def _cell_totals(spark: SparkSession, d: str) -> DataFrame:
    """(key, n_rows, n_distinct, total) of each cell: records, molecules, reads."""
    return skew.key_totals(skew.value_frequencies(table(spark, d, "bus_records"), "cb", "umi", "cnt"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bus_records").agg(F.count(F.lit(1)).alias("n")).scalar()
    return _cell_totals(spark, d).where(F.col("key").isNotNull() & (F.col("n_rows") >= 0.01 * rows)).select(F.col("key").alias("cb"))


def p1_cell_totals(spark: SparkSession, d: str) -> DataFrame:
    return _cell_totals(spark, d).select(F.col("key").alias("cb"), "n_rows", F.col("n_distinct").alias("n_molecules"), F.col("total").alias("reads"))


def p1_cell_modes(spark: SparkSession, d: str) -> DataFrame:
    modes = skew.key_modes(skew.value_frequencies(table(spark, d, "bus_records"), "cb", "cnt"))
    return modes.select(F.col("key").alias("cb"), "mode", "mode_n")


def p1_cell_percentiles(spark: SparkSession, d: str) -> DataFrame:
    freq = skew.value_frequencies(table(spark, d, "bus_records").where("cb is not null"), "cb", "umi")
    out = skew.key_percentiles(freq, PCTS)
    return out.select(F.col("key").alias("cb"), F.col("pct").cast("bigint").alias("pct"), F.col("value").alias("umi"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    bus, e2g, genes = (table(spark, d, t) for t in ("bus_records", "ec2gene", "genes"))
    members = e2g.select(F.explode("gene_ids").alias("gene_id"), "added_at")
    children = [orphans.Child("bus_records", bus, "ec", "seen_at", "ec2gene"), orphans.Child("ec2gene", members, "gene_id", "added_at", "genes")]
    parents = [orphans.Parent("ec2gene", e2g, "ec", "added_at", "removed_at"), orphans.Parent("genes", genes, "gene_id", "added_at", "removed_at")]
    return orphans.orphan_references(children, parents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("child").alias("tbl"), F.col("day").alias("ref_day"), F.col("key").alias("ref_id")).distinct()


def p2_orphans_by_day(spark: SparkSession, d: str) -> DataFrame:
    o = _orphans(spark, d).groupBy("child", "day").agg(F.sum("n").alias("n_rows"), F.countDistinct("key").alias("n_keys"))
    return o.select(F.col("child").alias("tbl"), F.col("day").alias("ref_day"), "n_rows", "n_keys")


def p2_orphan_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy(F.col("child").alias("tbl"), "reason").agg(F.sum("n").alias("n_rows"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return eav.bus_records_wide(table(spark, d, "record_attrs"), table(spark, d, "attr_terms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).where("cb is not null and ec is not null and cnt is not null").select("rec_id", "cb", "ec", "cnt")


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d)


def p3_attributes(spark: SparkSession, d: str) -> DataFrame:
    return eav.attribute_counts(table(spark, d, "record_attrs"), "attr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (p1_found, p1_cell_totals, p1_cell_modes, p1_cell_percentiles, p2_found, p2_orphans_by_day, p2_orphan_reasons, p3_found, p3_wide, p3_attributes)
    return {f.__name__: f for f in all_}


_ORPHAN_ROWS = """
WITH refs AS (
  SELECT 'bus_records' AS tbl, strftime(seen_at, '%Y-%m-%d') AS ref_day, ec AS ref_id, seen_at AS at FROM bus_records
  UNION ALL SELECT 'ec2gene', strftime(added_at, '%Y-%m-%d'), gene_id, added_at FROM (SELECT unnest(gene_ids) AS gene_id, added_at FROM ec2gene)
), parents AS (
  SELECT 'bus_records' AS tbl, ec AS id, added_at, removed_at FROM ec2gene UNION ALL SELECT 'ec2gene', gene_id, added_at, removed_at FROM genes
), orphans AS (
  SELECT * FROM refs r WHERE ref_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.tbl = r.tbl AND p.id = r.ref_id AND p.added_at <= r.at AND (p.removed_at IS NULL OR r.at < p.removed_at))
)"""

_WIDE = r"""
WITH named AS (
  SELECT rec_id, row_no, written_at, field, regexp_replace(attr_val, '^\s*"?\s*|\s*"?\s*$', '', 'g') AS t
  FROM record_attrs LEFT JOIN (SELECT DISTINCT regexp_replace(lower(term), '[^\p{L}\p{N}]', '', 'g') AS name, field FROM attr_terms WHERE field IN ('CB', 'EC', 'COUNT')) k
  ON regexp_replace(lower(attr), '[^\p{L}\p{N}]', '', 'g') = k.name
), parsed AS (
  SELECT *, CASE
    WHEN field = 'CB' AND regexp_full_match(t, '[ACGTacgt]{1,31}')
      THEN list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(upper(t), ''), lambda c: (strpos('ACGT', c) - 1)::HUGEINT)), lambda a, b: a * 4 + b)
    WHEN regexp_full_match(t, '\+?0[xX][0-9a-fA-F]{1,16}')
      THEN list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(lower(regexp_extract(t, '0[xX](.*)', 1)), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::HUGEINT)), lambda a, b: a * 16 + b)
    WHEN regexp_full_match(t, '[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]*)?([eE][+-]?[0-9]{1,2})?') THEN list_transform(
      [{'x': TRY_CAST(split_part(regexp_replace(replace(t, ',', ''), '[eE].*', '', 'g'), 'e', 1) AS DECIMAL(38, 12)), 'e': coalesce(TRY_CAST(nullif(regexp_extract(t, '[eE](.*)', 1), '') AS INTEGER), 0)}],
      lambda s: CASE WHEN s.e >= 0 AND s.x * CAST(power(10, s.e) AS HUGEINT) = floor(s.x * CAST(power(10, s.e) AS HUGEINT)) THEN TRY_CAST(s.x * CAST(power(10, s.e) AS HUGEINT) AS HUGEINT)
        WHEN s.e < 0 AND TRY_CAST(s.x AS HUGEINT) = s.x AND TRY_CAST(s.x AS HUGEINT) % CAST(power(10, -s.e) AS HUGEINT) = 0 THEN TRY_CAST(s.x AS HUGEINT) // CAST(power(10, -s.e) AS HUGEINT) END)[1] END AS v
  FROM named
), usable AS (
  SELECT *, row_number() OVER (PARTITION BY rec_id, field ORDER BY written_at DESC, row_no DESC) AS rn
  FROM parsed WHERE field IS NOT NULL AND v BETWEEN 0 AND CASE WHEN field = 'CB' THEN 18446744073709551615 ELSE 4294967295 END
), wide AS (
  SELECT i.rec_id, CAST(max(v) FILTER (field = 'CB') AS BIGINT) AS cb, CAST(max(v) FILTER (field = 'EC') AS BIGINT) AS ec, CAST(max(v) FILTER (field = 'COUNT') AS BIGINT) AS cnt
  FROM (SELECT DISTINCT rec_id FROM record_attrs WHERE rec_id IS NOT NULL) i LEFT JOIN usable u ON u.rec_id = i.rec_id AND rn = 1 GROUP BY i.rec_id
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT cb FROM bus_records WHERE cb IS NOT NULL GROUP BY cb HAVING count(*) >= 0.01 * (SELECT count(*) FROM bus_records)",
        "p1_cell_totals": "SELECT cb, count(*) AS n_rows, count(DISTINCT umi) AS n_molecules, CAST(sum(cnt) AS BIGINT) AS reads FROM bus_records GROUP BY cb",
        "p1_cell_modes": "SELECT cb, cnt AS mode, n AS mode_n FROM (SELECT cb, cnt, count(*) AS n, row_number() OVER (PARTITION BY cb ORDER BY count(*) DESC, cnt) AS r FROM bus_records WHERE cnt IS NOT NULL GROUP BY cb, cnt) WHERE r = 1",
        "p1_cell_percentiles": " UNION ALL ".join(f"SELECT cb, CAST({p} AS BIGINT) AS pct, quantile_disc(umi, {p / 100}) AS umi FROM bus_records WHERE cb IS NOT NULL AND umi IS NOT NULL GROUP BY cb" for p in PCTS),
        "p2_found": f"{_ORPHAN_ROWS} SELECT DISTINCT tbl, ref_day, ref_id FROM orphans",
        "p2_orphans_by_day": f"{_ORPHAN_ROWS} SELECT tbl, ref_day, count(*) AS n_rows, count(DISTINCT ref_id) AS n_keys FROM orphans GROUP BY tbl, ref_day",
        "p2_orphan_reasons": f"""{_ORPHAN_ROWS}, dated AS (
  SELECT o.tbl, CASE WHEN min(p.added_at) IS NULL THEN 'missing' WHEN min(p.added_at) > o.at THEN 'added_later' ELSE 'removed' END AS reason
  FROM (SELECT row_number() OVER () AS i, * FROM orphans) o LEFT JOIN parents p ON p.tbl = o.tbl AND p.id = o.ref_id AND (p.removed_at IS NULL OR p.removed_at > p.added_at) GROUP BY o.i, o.tbl, o.at
) SELECT tbl, reason, count(*) AS n_rows FROM dated GROUP BY tbl, reason""",
        "p3_found": f"{_WIDE} SELECT * FROM wide WHERE cb IS NOT NULL AND ec IS NOT NULL AND cnt IS NOT NULL",
        "p3_wide": f"{_WIDE} SELECT * FROM wide",
        "p3_attributes": r"SELECT regexp_replace(lower(attr), '[^\p{L}\p{N}]', '', 'g') AS attribute, count(*) AS n FROM record_attrs GROUP BY 1",
    }
