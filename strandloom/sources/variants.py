"""Variant text (VCF), regions (BED) and position lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.functions.sites import source_id
from strandloom.sources.bam import Tiles
from strandloom.sources.lines import is_block_compressed, read_lines

# Leading columns of a variant record.
VCF_COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]


def vcf_records(lines: DataFrame) -> DataFrame:
    """Variant records from lines (``value``, ``file``).

    Fields stay text next to a numeric ``pos`` and the file's ``vcf_source_id``; only the first
    sample column is kept.
    """
    fields = F.split("value", "\t", len(VCF_COLUMNS) + 1)
    records = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        *[F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(VCF_COLUMNS)],
        source_id(F.col("file")).alias("vcf_source_id"),
    )
    return records.withColumn("pos", F.col("pos").try_cast("int")).where(F.col("pos").isNotNull())


def read_vcf(spark: SparkSession, *paths: str, tiles: Tiles | None = None) -> DataFrame:
    """Variant records of plain or gzip files; block-compressed ones are split.

    With ``tiles``, those that have a position index give the records around the tiles only.
    """
    blocks = [p for p in paths if p.endswith(".gz") and is_block_compressed(p)]
    lines = []
    if others := [p for p in paths if p not in blocks]:
        lines.append(spark.read.text(others).select("value", F.col("_metadata.file_name").alias("file")))
    if blocks:
        lines.append(read_lines(spark, *blocks, tiles=tiles).select("value", "file"))
    return vcf_records(reduce(DataFrame.unionByName, lines))


def read_vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a variant file with their order, header flag, ``chrom``, ``pos`` and ``filter``."""
    fields = F.split("line", "\t", 8)
    if path.endswith(".gz") and is_block_compressed(path):
        lines = read_lines(spark, path).select(
            F.col("value").alias("line"), F.struct("block", "row").alias("ord"))
    else:
        lines = spark.read.text(path).select(
            F.col("value").alias("line"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("ord"),
        )
    return lines.withColumns({
        "is_header": F.col("line").startswith("#"),
        "chrom": F.get(fields, F.lit(0)),
        "pos": F.get(fields, F.lit(1)),
        "filter": F.get(fields, F.lit(6)),
    })


def float_quality_header(lines: DataFrame) -> DataFrame:
    """Declare the genotype quality as Float where the header says Integer."""
    is_gq = F.col("line").startswith("##FORMAT=<ID=GQ")
    fixed = F.regexp_replace("line", "^(.*?)Type=Integer", "$1Type=Float")
    return lines.withColumn("line", F.when(is_gq, fixed).otherwise(F.col("line")))


def bed_regions(lines: DataFrame) -> DataFrame:
    """Valid regions, 0-based half-open, from lines (``value``); unreadable lines are skipped."""
    text = F.regexp_replace("value", r"^[ \t]+|[ \t\r]+$", "")
    fields = F.split("text", r"\s+")
    return (
        lines.where(~F.col("value").startswith("#"))
        .select(text.alias("text")).where(F.col("text") != "")
        .select(
            F.get(fields, F.lit(0)).alias("chrom"),
            F.get(fields, F.lit(1)).try_cast("int").alias("start"),
            F.get(fields, F.lit(2)).try_cast("int").alias("end"),
        )
        .where((F.col("start") >= 0) & (F.col("end") > F.col("start")))
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return bed_regions(spark.read.text(path))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos) text pairs from the first two columns of a position list."""
    fields = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .select(F.get(fields, F.lit(0)).alias("chrom"), F.get(fields, F.lit(1)).alias("pos"))
        .where((F.col("chrom") != "") & ~F.col("chrom").startswith("#"))
    )
