"""The text files that come with records: classes, transcripts and genes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import Mapper, gene_mapper, transcript_mapper
from .bus_source import header_of, read_bus
from .records import Header


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a file with their 0-based numbers.

    Numbers need the whole file: it is one value, as these files are of some MB at most.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "value"))
    return lines.select(F.col("line_no").cast("bigint").alias("line_no"), "value").where("line_no > 0 or value <> ''")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, ec, transcripts) of lines ``ec tx,tx,...``; blank lines are passed over, others must be numbers."""
    parts = _lines(spark, path).where("trim(value) <> ''").withColumn("p", F.split(F.trim("value"), r"\s+"))
    return parts.select("line_no", F.col("p")[0].cast("bigint").alias("ec"), F.transform(F.split(F.col("p")[1], ","), lambda x: x.cast("bigint")).alias("transcripts"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(tx_line, tx_name): a whole line is a name, its 0-based number the id."""
    return _lines(spark, path).select(F.col("line_no").alias("tx_line"), F.col("value").alias("tx_name"))


def read_t2g(spark: SparkSession, path: str) -> DataFrame:
    """(tx_name, gene, symbol) of lines ``transcript gene symbol``; fewer columns are an error."""
    parts = spark.read.text(path).where("trim(value) <> ''").withColumn("p", F.split(F.trim("value"), r"\s+"))
    few = F.raise_error(F.concat(F.lit("a line needs three columns: "), F.col("value"))).cast("string")
    return parts.select(F.when(F.size("p") < 3, few).otherwise(F.col("p")[0]).alias("tx_name"), F.get("p", F.lit(1)).alias("gene"), F.get("p", F.lit(2)).alias("symbol"))


@dataclass(frozen=True)
class BusFolder:
    """A folder with records and their text files."""

    spark: SparkSession
    bus: str
    matrix: str
    transcripts: str

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> BusFolder:
        """The usual names within ``folder``."""
        return cls(spark, f"{folder}/output.corrected.sort.bus", f"{folder}/matrix.ec", f"{folder}/transcripts.txt")

    def header(self) -> Header:
        return header_of(self.bus)

    def records(self, **options: str) -> DataFrame:
        return read_bus(self.spark, self.bus, **options)

    def classes(self) -> DataFrame:
        return read_matrix(self.spark, self.matrix)

    def transcript_names(self) -> DataFrame:
        return read_transcripts(self.spark, self.transcripts)

    def gene_mapper(self, t2g: str, **policy: str) -> Mapper:
        return gene_mapper(self.classes(), self.transcript_names(), read_t2g(self.spark, t2g), **policy)

    def transcript_mapper(self, **policy: str) -> Mapper:
        return transcript_mapper(self.classes(), self.transcript_names(), **policy)

    def n_cells(self) -> DataFrame:
        return self.records().agg(F.countDistinct("CB").alias("n_cells"))

    def n_molecules(self) -> DataFrame:
        return self.records().select("CB", "UMI").distinct().agg(F.count(F.lit(1)).alias("n_molecules"))
