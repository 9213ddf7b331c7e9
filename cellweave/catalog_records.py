"""Queries of the record operators (grouping, classes, consistency, merging, codecs), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays, sequences
from .operators import consistency, grouping, mapping, merge, runs
from .plans.lineage import scratch
from .plans.tables import table
from .sources import sidecars
from .sources.bus_source import convert, header_of, index_files, read_bus, read_bytes, write_bus, write_head

BLOCK = 65_536
#: How the dirty tables are read: unknown transcripts and classes are passed over, of several genes the first is taken.
DROP, FIRST = "drop", "first"


def _bus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bus_records").select("pos", "cb", "umi", "ec", "cnt", "flag")


def _genes(spark: SparkSession, d: str) -> mapping.Mapper:
    return mapping.gene_mapper(table(spark, d, "ec_matrix"), table(spark, d, "transcripts"), table(spark, d, "t2g"), DROP, FIRST)


def _transcripts(spark: SparkSession, d: str) -> mapping.Mapper:
    return mapping.transcript_mapper(table(spark, d, "ec_matrix"), table(spark, d, "transcripts"), DROP)


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def q_groupby_cb(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_totals(_bus(spark, d), ["cb"])


def q_groupby_cbumi(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_totals(_bus(spark, d), ["cb", "umi"])


def q_molecule_records(spark: SparkSession, d: str) -> DataFrame:
    own = grouping.group_records(_bus(spark, d).where("cb is not null and umi is not null"), ["cb", "umi"])
    ecs = F.array_join(F.transform("records", lambda r: F.coalesce(r["ec"].cast("string"), F.lit("-"))), ",")
    return own.select("cb", "umi", F.size("records").cast("bigint").alias("n_records"), ecs.alias("ecs"))


def q_cell_pages(spark: SparkSession, d: str) -> DataFrame:
    own = grouping.group_pages(_bus(spark, d), ["cb"], page_rows=100)
    return own.groupBy("cb").agg(F.sum(F.size("records")).alias("n_records"), F.max(F.size("records") <= 100).alias("bounded"))


def q_cb_size(spark: SparkSession, d: str) -> DataFrame:
    return grouping.n_cells(_bus(spark, d))


def q_cbumi_size(spark: SparkSession, d: str) -> DataFrame:
    return grouping.n_molecules(_bus(spark, d))


def q_scan(spark: SparkSession, d: str) -> DataFrame:
    """Projection, filter and aggregates over a scan."""
    own = _bus(spark, d).where("flag = 0 and cnt > 1").select((F.col("cnt") * 2).alias("twice"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum("twice").alias("total"))


def q_write_partial(spark: SparkSession, d: str) -> DataFrame:
    return grouping.head_records(_bus(spark, d), 100)


def q_stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return grouping.stride_records(_bus(spark, d), 1000)


def q_check_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Whether check_sorted() lets records pass: all of them as delivered, and those before the first fall of (cb, umi)."""
    bus = _bus(spark, d).select("pos", "cb", "umi")
    first = grouping.order_faults(bus, ["cb", "umi"]).agg(F.min("pos").alias("p")).scalar()
    parts = {"all": bus, "before": bus.where(F.col("pos") < F.coalesce(first, F.lit((1 << 63) - 1)))}
    out = []
    for name, part in parts.items():
        try:
            n = grouping.check_sorted(part, ["cb", "umi"]).agg(F.count("pos").alias("n")).first()["n"]
            out.append((name, True, n))
        except Exception as e:
            if "Unsorted busfile: (" not in str(e):
                raise
            out.append((name, False, 0))
    return spark.createDataFrame(out, "part string, sorted boolean, n bigint")


def q_order_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every fall of (cb, umi) in the order of delivery; nulls are lowest."""
    own = grouping.order_faults(_bus(spark, d), ["cb", "umi"])
    return own.select("pos", "cb", "umi", F.col("prior.cb").alias("prior_cb"), F.col("prior.umi").alias("prior_umi"))


def q_ec2gene(spark: SparkSession, d: str) -> DataFrame:
    return _genes(spark, d).classes.select("ec", _joined("ids").alias("gene_ids"), _joined("names").alias("genes"))


def q_gene_ids(spark: SparkSession, d: str) -> DataFrame:
    return _genes(spark, d).names.select(F.col("id").alias("gene_id"), F.col("name").alias("gene"))


def q_ec2transcript(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d).classes.select("ec", _joined("ids").alias("tx_ids"), _joined("names").alias("tx_names"))


def q_transcript_ids(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d).names.select(F.col("id").alias("tx_id"), F.col("name").alias("tx_name"))


def q_resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Genes of the classes records refer to; of unknown classes null."""
    ecs = _bus(spark, d).where("ec is not null").select("ec").distinct()
    return _genes(spark, d).names_of(ecs).select("ec", _joined("names").alias("genes"))


def q_gene_listing(spark: SparkSession, d: str) -> DataFrame:
    """The listing of all genes, with the place of each in it."""
    return _genes(spark, d).listing().select(F.col("id").alias("place"), F.col("name").alias("gene"))


def q_resolve_ids(spark: SparkSession, d: str) -> DataFrame:
    """Names of the ids that classes hold and of some that none holds."""
    m = _genes(spark, d)
    ids = m.classes.select(F.explode("ids").alias("id")).distinct().unionByName(spark.range(-2, 0))
    return m.resolve(ids).select(F.col("id").alias("gene_id"), F.col("name").alias("gene"))


def q_resolve_transcripts(spark: SparkSession, d: str) -> DataFrame:
    m = _transcripts(spark, d)
    ids = m.ids_of(_bus(spark, d).where("ec is not null").select("ec").distinct()).select(F.explode("ids").alias("id")).distinct()
    return m.resolve(ids).select(F.col("id").alias("tx_id"), F.col("name").alias("tx_name"))


def q_strict_policies(spark: SparkSession, d: str) -> DataFrame:
    """Which of the strict policies stop on these tables: unknown transcripts, repeated transcripts, unknown classes."""
    matrix, tx, t2g, bus = table(spark, d, "ec_matrix"), table(spark, d, "transcripts"), table(spark, d, "t2g"), _bus(spark, d).where("ec is not null")
    tries = {
        "unknown transcript": lambda: mapping.gene_mapper(matrix, tx, t2g, "error", FIRST).sets,
        "duplicate transcript": lambda: mapping.gene_mapper(matrix, tx, t2g, DROP, "error").sets,
        "unknown class": lambda: consistency.find_consistent(bus, _genes(spark, d).sets, "names", on_missing="error"),
    }
    out = []
    for said, make in tries.items():
        try:
            make().write.format("noop").mode("overwrite").save()
            out.append((said, False))
        except Exception as e:
            if said not in str(e):
                raise
            out.append((said, True))
    return spark.createDataFrame(out, "policy string, stops boolean")


def q_strict_classes(spark: SparkSession, d: str) -> DataFrame:
    """The strict mapper on tables without faults: transcripts of one gene, classes of known transcripts only."""
    tx, t2g = table(spark, d, "transcripts"), mapping.one_gene_per_transcript(table(spark, d, "t2g"), FIRST)
    matrix = mapping.one_line_per_class(table(spark, d, "ec_matrix"))
    bad = matrix.select("ec", F.explode("transcripts").alias("tx_line")).join(tx, "tx_line", "left_anti").select("ec").distinct()
    return mapping.gene_mapper(matrix.join(bad, "ec", "left_anti"), tx, t2g).sets.select("ec", _joined("names").alias("genes"))


def q_consistent_unknown_empty(spark: SparkSession, d: str) -> DataFrame:
    """Molecules when records of unknown classes stand for nothing, instead of being passed over."""
    own = consistency.find_consistent(_bus(spark, d).where("ec is not null"), _genes(spark, d).sets, "names", on_missing="empty")
    return own.select("cb", "umi", "n_records", "status", _joined("genes").alias("genes"))


def _consistent(spark: SparkSession, d: str) -> DataFrame:
    return consistency.find_consistent(_bus(spark, d), _genes(spark, d).sets, "names", on_missing=DROP)


def q_find_consistent(spark: SparkSession, d: str) -> DataFrame:
    return _consistent(spark, d).select("cb", "umi", "n_records", "status", _joined("genes").alias("genes"))


def q_find_consistent_tx(spark: SparkSession, d: str) -> DataFrame:
    own = consistency.find_consistent(_bus(spark, d), _transcripts(spark, d).sets, "names", on_missing=DROP)
    return own.select("cb", "umi", "n_records", "status", _joined("genes").alias("genes"))


def q_cell_gene_counts(spark: SparkSession, d: str) -> DataFrame:
    return consistency.cell_gene_counts(_consistent(spark, d))


def q_groupbygene(spark: SparkSession, d: str) -> DataFrame:
    own = consistency.overlap_classes(_bus(spark, d), _genes(spark, d).sets, on_missing=DROP)
    return own.groupBy("cb", "umi", _joined("geneset").alias("geneset")).agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n"))


def _molecules(spark: SparkSession, d: str, mode: str, inconsistent: str = "ignore") -> DataFrame:
    classes = (_transcripts if mode == "transcript" else _genes)(spark, d).sets
    own = consistency.count_molecules(_bus(spark, d), classes, mode, inconsistent, on_missing=DROP)
    return own.groupBy("cb", "umi", "label").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n"))


def q_molecules_ec(spark: SparkSession, d: str) -> DataFrame:
    return _molecules(spark, d, "ec")


def q_molecules_transcript(spark: SparkSession, d: str) -> DataFrame:
    return _molecules(spark, d, "transcript")


def q_resolution_ignore(spark: SparkSession, d: str) -> DataFrame:
    return _molecules(spark, d, "gene", "ignore")


def q_resolution_single(spark: SparkSession, d: str) -> DataFrame:
    return _molecules(spark, d, "gene", "single")


def q_resolution_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _molecules(spark, d, "gene", "distinct")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bus_records").select("sample_id", "pos", "cb", "umi", "ec", "cnt")


def q_merge_cb(spark: SparkSession, d: str) -> DataFrame:
    own = merge.merge_totals(_samples(spark, d), ["cb"], "sample_id")
    said = F.array_join(F.array_sort(F.transform(F.map_entries("totals"), lambda e: F.concat_ws(":", e["key"], e["value"]["n_records"].cast("string"), e["value"]["n_reads"].cast("string")))), ",")
    return own.select("cb", said.alias("totals"))


def q_merge_cbumi(spark: SparkSession, d: str) -> DataFrame:
    own = merge.merge_records(_samples(spark, d), ["cb", "umi"], sample="sample_id")
    said = F.array_join(F.array_sort(F.transform(F.map_entries("records"), lambda e: F.concat_ws(":", e["key"], F.size(e["value"]).cast("string"), e["value"][0]["pos"].cast("string")))), ",")
    return own.select("cb", "umi", said.alias("records"))


def _separate(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The records of each sample as an input of its own; there is one for each sequencing run, so they are few."""
    own = _samples(spark, d)
    names = [r[0] for r in own.where("sample_id is not null").select("sample_id").distinct().collect()]
    return {n: own.where(F.col("sample_id") == n).drop("sample_id") for n in names}


def q_merge_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Cells of separately named inputs."""
    own = merge.merge_totals(merge.tagged(_separate(spark, d)), ["cb"])
    said = F.array_join(F.array_sort(F.transform(F.map_entries("totals"), lambda e: F.concat_ws(":", e["key"], e["value"]["n_records"].cast("string"), e["value"]["n_reads"].cast("string")))), ",")
    return own.select("cb", said.alias("totals"))


def q_merge_tagged_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Molecules of separately named inputs: in how many they occur, and with how many records."""
    own = merge.merge_records(merge.tagged(_separate(spark, d)), ["cb", "umi"])
    n = F.aggregate(F.map_values("records"), F.lit(0), lambda a, r: a + F.size(r))
    return own.select("cb", "umi", F.size("records").cast("bigint").alias("n_samples"), n.cast("bigint").alias("n_records"))


def q_merge_shared(spark: SparkSession, d: str) -> DataFrame:
    """Cells that occur in lib_a1 and not in lib_b1: semi- and anti-join of the merge."""
    own = merge.in_samples(merge.merge_totals(_samples(spark, d), ["cb"], "sample_id"), "totals", ["lib_a1"], ["lib_b1"])
    return own.where("cb is not null").select("cb")


def q_seq_decode(spark: SparkSession, d: str) -> DataFrame:
    own = _bus(spark, d).where("cb is not null").select("cb").distinct()
    return own.select("cb", sequences.decode_sequence(F.col("cb"), 16).alias("seq"))


def q_seq_encode(spark: SparkSession, d: str) -> DataFrame:
    own = _bus(spark, d).where("umi is not null").select(sequences.decode_sequence(F.col("umi"), 12).alias("seq")).distinct()
    return own.select("seq", sequences.encode_sequence(F.col("seq")).alias("umi"))


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    """The counts of each molecule's records, in order of pos."""
    own = grouping.group_records(_bus(spark, d).where("cb is not null and umi is not null and cnt is not null").select("pos", "cb", "umi", "cnt"), ["cb", "umi"])
    return own.select("cb", "umi", F.transform("records", lambda r: r["cnt"]).alias("v"))


def q_argsort(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("cb", "umi", F.array_join(arrays.argsort(F.col("v")).cast("array<string>"), ",").alias("order_"))


def q_argsort_float(spark: SparkSession, d: str) -> DataFrame:
    order = arrays.argsort_floats(F.col("v").cast("array<double>"), True)
    return _arrays(spark, d).select("cb", "umi", F.array_join(order.cast("array<string>"), ",").alias("order_"))


def q_argmax(spark: SparkSession, d: str) -> DataFrame:
    best = arrays.argmax(F.col("v"))
    return _arrays(spark, d).select("cb", "umi", best["index"].cast("bigint").alias("i"), best["value"].alias("value"))


def q_argmin(spark: SparkSession, d: str) -> DataFrame:
    best = arrays.argmin(F.col("v"))
    return _arrays(spark, d).select("cb", "umi", best["index"].cast("bigint").alias("i"), best["value"].alias("value"))


def q_min_argmin(spark: SparkSession, d: str) -> DataFrame:
    best = arrays.min_argmin(F.col("v"))
    return _arrays(spark, d).select("cb", "umi", best["value"].alias("value"), F.array_join(best["indices"].cast("array<string>"), ",").alias("at"))


def q_as_set(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("cb", "umi", F.array_join(arrays.as_set(F.col("v")).cast("array<string>"), ",").alias("counts"))


def _blocked(spark: SparkSession, d: str) -> DataFrame:
    return runs.deltas(runs.with_block(_bus(spark, d).where("cb is not null and umi is not null"), BLOCK))


def q_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _blocked(spark, d).select("pos", "d_cb", "d_umi")


def q_undo_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Differences and back; what comes out must be what went in."""
    return runs.undo_deltas(_blocked(spark, d).select("block", "pos", "d_cb", "d_umi")).select("pos", "cb", "umi")


def q_cb_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs_of(_blocked(spark, d), "d_cb", 0).select("block", "first", "value", "length")


def q_undo_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal differences and back, on the ordinals of records within blocks, which have no gaps."""
    own = _blocked(spark, d).select("block", "pos", "d_cb")
    ordinal = own.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy("pos")).cast("bigint") - 1)
    return runs.undo_runs(runs.runs_of(ordinal, "d_cb", 0)).select("block", F.col("pos").cast("bigint").alias("ordinal"), F.col("value").alias("d_cb"))


def _holdable(spark: SparkSession, d: str) -> DataFrame:
    """Records that a file can hold, with pos."""
    own = _bus(spark, d).where("cb >= 0 and umi >= 0 and ec between 0 and 4294967295 and cnt between 1 and 4294967295 and flag between 0 and 4294967295")
    return own.select("pos", F.col("cb").alias("CB"), F.col("umi").alias("UMI"), F.col("ec").alias("EC"), F.col("cnt").alias("COUNT"), F.col("flag").alias("FLAG"))


def _file_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same without pos, so in order of CB, UMI and EC when written."""
    return _holdable(spark, d).drop("pos")


def _totals(records: DataFrame) -> DataFrame:
    return records.groupBy("CB", "UMI", "EC").agg(F.sum("COUNT").alias("cnt"), F.sum("FLAG").alias("flags"), F.count(F.lit(1)).alias("n"))


def _written(spark: SparkSession, d: str, suffix: str, **options: str) -> str:
    """A path with all records that a file can hold."""
    path = scratch(spark, suffix)
    write_bus(_file_rows(spark, d), path, **options)
    return path


def q_bus_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _totals(read_bus(spark, _written(spark, d, ".bus"), rows="20000"))


def q_busz_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _totals(read_bus(spark, _written(spark, d, ".busz"), rows="20000"))


def q_forced_codec(spark: SparkSession, d: str) -> DataFrame:
    """Compressed records under a name that says plain."""
    path = _written(spark, d, ".bus", codec="blocks", layout="file")
    return _totals(read_bus(spark, path, codec="blocks"))


def q_convert(spark: SparkSession, d: str) -> DataFrame:
    """Plain to compressed to plain."""
    path, packed, plain = _written(spark, d, ".bus"), scratch(spark, ".busz"), scratch(spark, ".bus")
    convert(spark, path, packed)
    index_files(spark, packed)
    convert(spark, packed, plain)
    return _totals(read_bus(spark, plain))


def q_read_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Files of both kinds held as bytes; each record is in both."""
    paths = [_written(spark, d, s) for s in (".bus", ".busz")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bus*").load(paths)
    own = read_bytes(files.where("path not like '%.idx'")).drop("path", "pos")
    return own.groupBy("CB", "UMI", "EC").agg((F.sum("COUNT") / 2).cast("bigint").alias("cnt"), (F.sum("FLAG") / 2).cast("bigint").alias("flags"), (F.count(F.lit(1)) / 2).cast("bigint").alias("n"))


def q_header(spark: SparkSession, d: str) -> DataFrame:
    """Kind and lengths from the headers of files of both kinds."""
    heads = [header_of(_written(spark, d, s, cb_len=str(c), umi_len="9")) for s, c in ((".bus", 16), (".busz", 20))]
    return spark.createDataFrame([(h.kind, h.cb_len, h.umi_len) for h in heads], "kind string, cb_len bigint, umi_len bigint")


def q_write_head(spark: SparkSession, d: str) -> DataFrame:
    """The first 1,000 records of a file, in the order of delivery, as a file of their own: a limit is the feature here."""
    path, head = scratch(spark, ".bus"), scratch(spark, ".bus")
    write_bus(_holdable(spark, d), path)
    write_head(spark, path, head, 1000)
    return read_bus(spark, head).select("pos", "CB", "UMI", "EC", "COUNT", "FLAG")


def _folder(spark: SparkSession, d: str) -> tuple[sidecars.BusFolder, str]:
    """All records with classes, transcripts and genes as the text files of a folder; of repeated classes one line."""
    base = scratch(spark)
    bus, matrix, names, genes = (f"{base}/{x}" for x in ("output.corrected.sort.bus", "matrix.ec", "transcripts.txt", "t2g.txt"))
    write_bus(_file_rows(spark, d), bus)
    lines = mapping.one_line_per_class(table(spark, d, "ec_matrix")).orderBy("ec").select(F.concat_ws(" ", F.col("ec").cast("string"), _joined("transcripts")))
    lines.coalesce(1).write.text(matrix)
    table(spark, d, "transcripts").orderBy("tx_line").select("tx_name").coalesce(1).write.text(names)
    mapping.one_gene_per_transcript(table(spark, d, "t2g"), FIRST).where("gene is not null").select(F.concat_ws("\t", "tx_name", "gene", F.lit("-"))).write.text(genes)
    return sidecars.BusFolder.of(spark, base), genes


def q_folder_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _folder(spark, d)[0].classes().select("line_no", "ec", _joined("transcripts").alias("transcripts"))


def q_folder_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return _folder(spark, d)[0].transcript_names()


def q_folder_t2g(spark: SparkSession, d: str) -> DataFrame:
    return sidecars.read_t2g(spark, _folder(spark, d)[1]).select("tx_name", "gene")


def q_folder_genes(spark: SparkSession, d: str) -> DataFrame:
    """The genes of every class, from the text files of a folder."""
    folder, genes = _folder(spark, d)
    return folder.gene_mapper(genes, on_missing=DROP).classes.select("ec", _joined("ids").alias("gene_ids"), _joined("names").alias("genes"))


def q_folder_transcript_classes(spark: SparkSession, d: str) -> DataFrame:
    return _folder(spark, d)[0].transcript_mapper(on_missing=DROP).classes.select("ec", _joined("ids").alias("tx_ids"), _joined("names").alias("tx_names"))


def q_folder_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Cells, molecules and records of a folder, and the lengths in its header."""
    folder = _folder(spark, d)[0]
    head, n = folder.header(), folder.records().agg(F.count(F.lit(1)).alias("n_records"))
    return n.select("n_records", folder.n_cells().scalar().alias("n_cells"), folder.n_molecules().scalar().alias("n_molecules"), F.lit(head.cb_len).cast("bigint").alias("cb_len"), F.lit(head.umi_len).cast("bigint").alias("umi_len"))


def q_in_memory(spark: SparkSession, d: str) -> DataFrame:
    """Records that come from no file, beside those of a table: a source is any DataFrame."""
    held = spark.createDataFrame([(-1, 7, 1, 0, 12, 0), (-2, 7, 2, 1, 2, 0), (-3, 8, 1, 0, 3, 0)], "pos bigint, cb bigint, umi bigint, ec bigint, cnt bigint, flag bigint")
    return grouping.group_totals(held.unionByName(_bus(spark, d)), ["cb"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("q_")}


# --- SQL -----------------------------------------------------------------------------------

_CLASSES = """m AS (SELECT ec, max(transcripts) AS tx FROM ec_matrix WHERE ec IS NOT NULL GROUP BY ec),
 n AS (SELECT DISTINCT ec, tx_name FROM (SELECT ec, unnest(tx) AS tx_line FROM m) JOIN transcripts USING (tx_line)),
 g AS (SELECT tx_name, min(gene) AS gene FROM t2g WHERE tx_name IS NOT NULL GROUP BY tx_name),
 eg AS (SELECT DISTINCT ec, gene FROM n JOIN g USING (tx_name) WHERE gene IS NOT NULL),
 et AS (SELECT DISTINCT ec, tx_name AS gene FROM n)"""
_IDS = "ids AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS id FROM (SELECT DISTINCT gene FROM {e}))"


def _class_sql(e: str, id_name: str, name: str) -> str:
    return f"""WITH {_CLASSES}, {_IDS.format(e=e)} SELECT m.ec, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY gene), '') AS {id_name}, coalesce(string_agg(gene, ',' ORDER BY gene), '') AS {name}
 FROM m LEFT JOIN (SELECT ec, gene, id FROM {e} JOIN ids USING (gene)) x ON x.ec = m.ec GROUP BY m.ec"""


def _ids_sql(e: str, id_name: str, name: str) -> str:
    return f"WITH {_CLASSES}, {_IDS.format(e=e)} SELECT id AS {id_name}, gene AS {name} FROM ids"


def _agreed(e: str) -> str:
    """Relational division: the genes that belong to every class of a molecule."""
    return f"""{_CLASSES}, rec AS (SELECT cb, umi, ec, count(*) AS n, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS c FROM bus_records SEMI JOIN m USING (ec) WHERE cb IS NOT NULL AND umi IS NOT NULL GROUP BY ALL),
 tot AS (SELECT cb, umi, CAST(sum(n) AS BIGINT) AS n_records, count(*) AS k, CAST(sum(c) AS BIGINT) AS cnt FROM rec GROUP BY ALL),
 com AS (SELECT cb, umi, gene FROM rec JOIN {e} USING (ec) JOIN tot USING (cb, umi) GROUP BY cb, umi, gene, k HAVING count(*) = k),
 agreed AS (SELECT t.cb, t.umi, n_records, any_value(t.cnt) AS cnt, CASE WHEN count(gene) = 1 THEN 'SingleGene' WHEN count(gene) = 0 AND n_records > 1 THEN 'Inconsistent' ELSE 'Multimapped' END AS status,
  coalesce(string_agg(gene, ',' ORDER BY gene), '') AS genes FROM tot t LEFT JOIN com c ON c.cb = t.cb AND c.umi = t.umi GROUP BY t.cb, t.umi, n_records)"""


#: The fold as a recursive query, one record of each molecule a step.
_FOLD = """sets AS MATERIALIZED (SELECT m.ec, coalesce(list(gene ORDER BY gene) FILTER (gene IS NOT NULL), []) AS gs FROM m LEFT JOIN eg ON eg.ec = m.ec GROUP BY m.ec),
 r AS MATERIALIZED (SELECT cb, umi, row_number() OVER (PARTITION BY cb, umi ORDER BY pos) AS i, coalesce(cnt, 0) AS c, gs FROM bus_records JOIN sets USING (ec) WHERE cb IS NOT NULL AND umi IS NOT NULL),
 f AS (SELECT cb, umi, i, [{'k': gs, 'c': c}] AS acc FROM r WHERE i = 1
  UNION ALL SELECT cb, umi, i, CASE WHEN j IS NULL THEN list_append(acc, {'k': gs, 'c': c}) ELSE list_append(list_concat(acc[1:j - 1], acc[j + 1:]), {'k': list_intersect(acc[j].k, gs), 'c': acc[j].c + c}) END
  FROM (SELECT r.cb, r.umi, r.i, r.c, r.gs, f.acc, list_position(list_transform(f.acc, lambda e: list_has_any(e.k, r.gs)), true) AS j FROM f JOIN r ON r.cb = f.cb AND r.umi = f.umi AND r.i = f.i + 1)),
 folded AS (SELECT cb, umi, array_to_string(list_sort(e.k), ',') AS label, e.c AS cnt FROM (SELECT cb, umi, unnest(acc) AS e FROM f QUALIFY row_number() OVER (PARTITION BY cb, umi ORDER BY i DESC) = 1))"""

_LABELS = "SELECT cb, umi, label, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n FROM ({}) GROUP BY cb, umi, label"
_V = "v AS (SELECT cb, umi, cnt, row_number() OVER (PARTITION BY cb, umi ORDER BY pos) - 1 AS i FROM bus_records WHERE cb IS NOT NULL AND umi IS NOT NULL AND cnt IS NOT NULL)"
_D = f"""o AS (SELECT pos, cb, umi, pos // {BLOCK} AS block, lag(cb) OVER w AS lcb, lag(umi) OVER w AS lumi FROM bus_records WHERE cb IS NOT NULL AND umi IS NOT NULL WINDOW w AS (PARTITION BY pos // {BLOCK} ORDER BY pos)),
 dl AS (SELECT pos, block, cb - coalesce(lcb, 0) AS d_cb, CASE WHEN lcb = cb THEN umi - lumi ELSE umi + 1 END AS d_umi FROM o)"""
_HOLDABLE = "cb >= 0 AND umi >= 0 AND ec BETWEEN 0 AND 4294967295 AND cnt BETWEEN 1 AND 4294967295 AND flag BETWEEN 0 AND 4294967295"
_FILE = f"""SELECT cb AS "CB", umi AS "UMI", ec AS "EC", CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(flag) AS BIGINT) AS flags, count(*) AS n FROM bus_records WHERE {_HOLDABLE} GROUP BY ALL"""
_MERGED = "SELECT cb, string_agg(sample_id || ':' || n || ':' || s, ',' ORDER BY sample_id) AS totals FROM (SELECT cb, sample_id, count(*) AS n, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS s FROM bus_records WHERE sample_id IS NOT NULL GROUP BY ALL) GROUP BY cb"
_FALLS = """o AS (SELECT pos, cb, umi, lag(pos) OVER w AS prior_pos, lag(cb) OVER w AS prior_cb, lag(umi) OVER w AS prior_umi FROM bus_records WINDOW w AS (ORDER BY pos)),
 falls AS (SELECT pos, cb, umi, prior_cb, prior_umi FROM o WHERE prior_pos IS NOT NULL AND (coalesce(prior_cb, -1) > coalesce(cb, -1) OR (prior_cb IS NOT DISTINCT FROM cb AND coalesce(prior_umi, -1) > coalesce(umi, -1))))"""


def oracle_sql() -> dict[str, str]:
    totals = "SELECT {k}, count(*) AS n_records, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS n_reads FROM bus_records GROUP BY ALL"
    bases = " || ".join("substr('ACGT', CAST((x >> {}) & 3 AS INTEGER) + 1, 1)".format(2 * i) for i in range(15, -1, -1))
    short = " || ".join("substr('ACGT', CAST((x >> {}) & 3 AS INTEGER) + 1, 1)".format(2 * i) for i in range(11, -1, -1))
    consistent = "SELECT cb, umi, n_records, status, genes FROM agreed"
    return {
        "q_groupby_cb": totals.format(k="cb"),
        "q_groupby_cbumi": totals.format(k="cb, umi"),
        "q_molecule_records": "SELECT cb, umi, count(*) AS n_records, string_agg(coalesce(CAST(ec AS VARCHAR), '-'), ',' ORDER BY pos) AS ecs FROM bus_records WHERE cb IS NOT NULL AND umi IS NOT NULL GROUP BY cb, umi",
        "q_cell_pages": "SELECT cb, count(*) AS n_records, true AS bounded FROM bus_records GROUP BY cb",
        "q_cb_size": "SELECT count(DISTINCT cb) AS n_cells FROM bus_records",
        "q_cbumi_size": "SELECT count(*) AS n_molecules FROM (SELECT DISTINCT cb, umi FROM bus_records WHERE cb IS NOT NULL AND umi IS NOT NULL)",
        "q_scan": "SELECT count(*) AS n, CAST(sum(cnt * 2) AS BIGINT) AS total FROM bus_records WHERE flag = 0 AND cnt > 1",
        "q_write_partial": "SELECT pos, cb, umi, ec, cnt, flag FROM bus_records ORDER BY pos LIMIT 100",
        "q_stride_sample": "SELECT pos, cb, umi, ec, cnt, flag FROM bus_records WHERE pos % 1000 = 0",
        "q_check_sorted": f"WITH {_FALLS} SELECT 'all' AS part, NOT EXISTS (SELECT 1 FROM falls) AS sorted, CASE WHEN NOT EXISTS (SELECT 1 FROM falls) THEN count(*) ELSE 0 END AS n FROM bus_records UNION ALL SELECT 'before', true, count(*) FROM bus_records WHERE pos < coalesce((SELECT min(pos) FROM falls), 9223372036854775807)",
        "q_order_faults": f"WITH {_FALLS} SELECT * FROM falls",
        "q_gene_listing": _ids_sql("eg", "place", "gene"),
        "q_resolve_ids": _ids_sql("eg", "gene_id", "gene") + " UNION ALL SELECT -2, NULL UNION ALL SELECT -1, NULL",
        "q_resolve_transcripts": f"WITH {_CLASSES}, {_IDS.format(e='et')} SELECT DISTINCT id AS tx_id, gene AS tx_name FROM et JOIN ids USING (gene) WHERE ec IN (SELECT ec FROM bus_records)",
        "q_strict_policies": f"""WITH {_CLASSES} SELECT 'unknown transcript' AS policy, EXISTS (SELECT 1 FROM (SELECT unnest(tx) AS tx_line FROM m) WHERE tx_line NOT IN (SELECT tx_line FROM transcripts)) AS stops
 UNION ALL SELECT 'duplicate transcript', EXISTS (SELECT 1 FROM t2g WHERE tx_name IN (SELECT tx_name FROM n) GROUP BY tx_name HAVING count(*) > 1)
 UNION ALL SELECT 'unknown class', EXISTS (SELECT 1 FROM bus_records WHERE ec IS NOT NULL AND ec NOT IN (SELECT ec FROM m))""",
        "q_strict_classes": f"""WITH {_CLASSES}, bad AS (SELECT DISTINCT ec FROM (SELECT ec, unnest(tx) AS tx_line FROM m) WHERE tx_line NOT IN (SELECT tx_line FROM transcripts))
 SELECT m.ec, coalesce(string_agg(gene, ',' ORDER BY gene), '') AS genes FROM m LEFT JOIN eg ON eg.ec = m.ec WHERE m.ec NOT IN (SELECT ec FROM bad) GROUP BY m.ec""",
        "q_consistent_unknown_empty": f"WITH {_agreed('eg').replace('FROM bus_records SEMI JOIN m USING (ec) WHERE cb', 'FROM bus_records WHERE ec IS NOT NULL AND cb')} {consistent}",
        "q_merge_tagged": _MERGED,
        "q_merge_tagged_molecules": "SELECT cb, umi, count(DISTINCT sample_id) AS n_samples, count(*) AS n_records FROM bus_records WHERE sample_id IS NOT NULL GROUP BY cb, umi",
        "q_as_set": f"WITH {_V} SELECT cb, umi, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY cnt) AS counts FROM (SELECT DISTINCT cb, umi, cnt FROM v) GROUP BY cb, umi",
        "q_undo_runs": f"WITH {_D} SELECT block, row_number() OVER (PARTITION BY block ORDER BY pos) - 1 AS ordinal, d_cb FROM dl",
        "q_ec2gene": _class_sql("eg", "gene_ids", "genes"),
        "q_gene_ids": _ids_sql("eg", "gene_id", "gene"),
        "q_ec2transcript": _class_sql("et", "tx_ids", "tx_names"),
        "q_transcript_ids": _ids_sql("et", "tx_id", "tx_name"),
        "q_resolve_names": f"WITH {_CLASSES} SELECT b.ec, CASE WHEN m.ec IS NOT NULL THEN coalesce(string_agg(gene, ',' ORDER BY gene), '') END AS genes FROM (SELECT DISTINCT ec FROM bus_records WHERE ec IS NOT NULL) b LEFT JOIN m ON m.ec = b.ec LEFT JOIN eg ON eg.ec = b.ec GROUP BY b.ec, m.ec",
        "q_find_consistent": f"WITH {_agreed('eg')} {consistent}",
        "q_find_consistent_tx": f"WITH {_agreed('et')} {consistent}",
        "q_cell_gene_counts": f"WITH {_agreed('eg')} SELECT cb, genes AS gene, count(*) AS n_molecules FROM agreed WHERE status = 'SingleGene' GROUP BY cb, genes",
        "q_groupbygene": f"WITH RECURSIVE {_CLASSES}, {_FOLD} SELECT cb, umi, label AS geneset, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n FROM folded GROUP BY cb, umi, label",
        "q_molecules_ec": _LABELS.format("SELECT cb, umi, CAST(ec AS VARCHAR) AS label, coalesce(sum(cnt), 0) AS cnt FROM bus_records WHERE cb IS NOT NULL AND umi IS NOT NULL AND ec IS NOT NULL GROUP BY cb, umi, ec"),
        "q_molecules_transcript": f"WITH {_agreed('et')} {_LABELS.format('SELECT cb, umi, genes AS label, cnt FROM agreed WHERE status <> $$Inconsistent$$')}",
        "q_resolution_ignore": f"WITH {_agreed('eg')} {_LABELS.format('SELECT cb, umi, genes AS label, cnt FROM agreed WHERE status <> $$Inconsistent$$')}",
        "q_resolution_single": f"WITH {_agreed('eg')} {_LABELS.format('SELECT cb, umi, genes AS label, cnt FROM agreed')}",
        "q_resolution_distinct": f"WITH RECURSIVE {_agreed('eg')}, {_FOLD} "
        + _LABELS.format("SELECT cb, umi, genes AS label, cnt FROM agreed WHERE status <> $$Inconsistent$$ UNION ALL SELECT cb, umi, label, folded.cnt FROM folded SEMI JOIN (SELECT cb, umi FROM agreed WHERE status = $$Inconsistent$$) x USING (cb, umi)"),
        "q_merge_cb": _MERGED,
        "q_merge_cbumi": "SELECT cb, umi, string_agg(sample_id || ':' || n || ':' || p, ',' ORDER BY sample_id) AS records FROM (SELECT cb, umi, sample_id, count(*) AS n, min(pos) AS p FROM bus_records WHERE sample_id IS NOT NULL GROUP BY ALL) GROUP BY cb, umi",
        "q_merge_shared": "SELECT cb FROM bus_records WHERE cb IS NOT NULL AND sample_id = 'lib_a1' EXCEPT SELECT cb FROM bus_records WHERE sample_id = 'lib_b1'",
        "q_seq_decode": f"SELECT x AS cb, {bases} AS seq FROM (SELECT DISTINCT cb AS x FROM bus_records WHERE cb IS NOT NULL)",
        "q_seq_encode": f"SELECT {short} AS seq, x AS umi FROM (SELECT DISTINCT umi AS x FROM bus_records WHERE umi IS NOT NULL)",
        "q_argsort": f"WITH {_V} SELECT cb, umi, string_agg(CAST(i AS VARCHAR), ',' ORDER BY cnt, i) AS order_ FROM v GROUP BY cb, umi",
        "q_argsort_float": f"WITH {_V} SELECT cb, umi, string_agg(CAST(i AS VARCHAR), ',' ORDER BY cnt DESC, i DESC) AS order_ FROM v GROUP BY cb, umi",
        "q_argmax": f"WITH {_V} SELECT cb, umi, i, cnt AS value FROM v QUALIFY row_number() OVER (PARTITION BY cb, umi ORDER BY cnt DESC, i DESC) = 1",
        "q_argmin": f"WITH {_V} SELECT cb, umi, i, cnt AS value FROM v QUALIFY row_number() OVER (PARTITION BY cb, umi ORDER BY cnt, i) = 1",
        "q_min_argmin": f"WITH {_V} SELECT cb, umi, cnt AS value, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS at FROM (SELECT * FROM v QUALIFY rank() OVER (PARTITION BY cb, umi ORDER BY cnt) = 1) GROUP BY cb, umi, cnt",
        "q_deltas": f"WITH {_D} SELECT pos, d_cb, d_umi FROM dl",
        "q_undo_deltas": "SELECT pos, cb, umi FROM bus_records WHERE cb IS NOT NULL AND umi IS NOT NULL",
        "q_cb_runs": f"""WITH {_D}, mk AS (SELECT *, CASE WHEN d_cb = 0 AND lag(d_cb) OVER w = 0 THEN 0 ELSE 1 END AS new FROM dl WINDOW w AS (PARTITION BY block ORDER BY pos)),
 rn AS (SELECT *, sum(new) OVER (PARTITION BY block ORDER BY pos) AS run FROM mk) SELECT block, min(pos) AS first, min(d_cb) AS value, count(*) AS length FROM rn GROUP BY block, run""",
        **dict.fromkeys(("q_bus_roundtrip", "q_busz_roundtrip", "q_forced_codec", "q_convert", "q_read_bytes"), _FILE),
        "q_header": "SELECT 'plain' AS kind, CAST(16 AS BIGINT) AS cb_len, CAST(9 AS BIGINT) AS umi_len UNION ALL SELECT 'blocks', 20, 9",
        "q_write_head": f'SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, cb AS "CB", umi AS "UMI", ec AS "EC", cnt AS "COUNT", flag AS "FLAG" FROM (SELECT * FROM bus_records WHERE {_HOLDABLE} ORDER BY pos LIMIT 1000)',
        "q_folder_matrix": f"WITH {_CLASSES} SELECT row_number() OVER (ORDER BY ec) - 1 AS line_no, ec, array_to_string(tx, ',') AS transcripts FROM m",
        "q_folder_transcripts": "SELECT tx_line, tx_name FROM transcripts",
        "q_folder_t2g": f"WITH {_CLASSES} SELECT tx_name, gene FROM g WHERE gene IS NOT NULL",
        "q_folder_genes": _class_sql("eg", "gene_ids", "genes"),
        "q_folder_transcript_classes": _class_sql("et", "tx_ids", "tx_names"),
        "q_folder_sizes": f"SELECT count(*) AS n_records, count(DISTINCT cb) AS n_cells, (SELECT count(*) FROM (SELECT DISTINCT cb, umi FROM bus_records WHERE {_HOLDABLE})) AS n_molecules, CAST(16 AS BIGINT) AS cb_len, CAST(12 AS BIGINT) AS umi_len FROM bus_records WHERE {_HOLDABLE}",
        "q_in_memory": "SELECT cb, count(*) AS n_records, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS n_reads FROM (SELECT cb, cnt FROM bus_records UNION ALL SELECT * FROM (VALUES (7, 12), (7, 2), (8, 3))) GROUP BY cb",
    }
