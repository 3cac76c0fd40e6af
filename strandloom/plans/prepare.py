"""Variant file preparation: PASS filter, split by position lists, one chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators.balance import semi_join
from strandloom.operators.variants import strict_pass_records
from strandloom.sinks.reports import write_vcf_lines
from strandloom.sources.variants import float_quality_header, read_positions, read_vcf_lines


def _with_headers(lines: DataFrame, keep) -> DataFrame:
    """Header lines unchanged, followed by the records ``keep`` retains."""
    return lines.where("is_header").unionByName(keep(lines.where("not is_header")))


def pass_filter(
    spark: SparkSession, vcf: str, out: str, float_quality: bool = True, mode: str = "errorifexists"
) -> None:
    """Records whose filter is exactly PASS, optionally with the quality header mended."""
    lines = _with_headers(read_vcf_lines(spark, vcf), strict_pass_records)
    write_vcf_lines(float_quality_header(lines) if float_quality else lines, out, mode=mode)


def select_positions(
    spark: SparkSession, vcf: str, positions: str, out: str, chrom: str | None = None,
    gzip: bool = True, mode: str = "errorifexists",
) -> None:
    """Records at the listed positions, optionally of one chromosome."""
    wanted = read_positions(spark, positions)

    def keep(records: DataFrame) -> DataFrame:
        if chrom:
            records = records.where(F.col("chrom") == chrom)
        return semi_join(records, wanted, ["chrom", "pos"], ["line"])

    write_vcf_lines(_with_headers(read_vcf_lines(spark, vcf), keep), out, gzip, mode)
