"""Variant records to analysed variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.functions import sites as S
from strandloom.operators.balance import semi_join
from strandloom.operators.overlap import points_in_regions


def pass_records(records: DataFrame) -> DataFrame:
    return records.where(S.passes_filter(F.col("filter")))


def strict_pass_records(records: DataFrame) -> DataFrame:
    return records.where(S.passes_filter_strictly(F.col("filter")))


def records_on(records: DataFrame, chrom: str) -> DataFrame:
    return records.where(F.col("chrom") == chrom)


def split_alleles(records: DataFrame) -> DataFrame:
    """One row per ALT allele with its 1-based number; records without ALT disappear."""
    alts = F.filter(F.split("alt", ","), lambda a: (a != ".") & (a != ""))
    typed = records.withColumn("_alts", alts).withColumn(
        "variant_type", S.variant_type(F.col("ref"), F.col("_alts"))
    )
    return (
        typed.select(*[c for c in typed.columns if c not in ("alt", "_alts")],
                     F.posexplode("_alts").alias("_index", "alt"))
        .withColumn("allele_index", F.col("_index") + 1)
        .drop("_index")
    )


def with_sample_depths(records: DataFrame) -> DataFrame:
    """Allele depths (AD) of the first sample as text array, NULL where the key is absent."""
    place = F.array_position(F.split("format", ":"), "AD")
    values = F.split("sample", ":")
    ad = F.when(place > 0, F.get(values, (place - 1).cast("int")))
    return records.withColumn("ad", F.split(ad, ","))


def supported_alleles(alleles: DataFrame, min_allele: float) -> DataFrame:
    """Drop alleles whose depth is known and below the minimum.

    A present but empty depth (``.``) counts as below it; a record without depths is kept.
    """
    if min_allele <= 0:
        return alleles
    depth = F.get("ad", F.col("allele_index")).try_cast("int")
    enough = F.coalesce(depth >= F.lit(min_allele).cast("float"), F.lit(False))
    return alleles.where(F.col("ad").isNull() | enough)


def in_regions(records: DataFrame, regions: DataFrame | None) -> DataFrame:
    """Records whose 0-based position lies in a region; no valid region means no restriction."""
    if regions is None or regions.isEmpty():
        return records
    placed = records.withColumn("_pos0", F.col("pos") - 1)
    return points_in_regions(placed, regions, "_pos0").drop("_pos0")


def variants_from_records(
    records: DataFrame, min_allele: float = 0, regions: DataFrame | None = None
) -> DataFrame:
    """Filter, restrict, split and type VCF records."""
    kept = in_regions(pass_records(records), regions)
    alleles = supported_alleles(split_alleles(with_sample_depths(kept)), min_allele)
    qual = F.col("qual").try_cast("float")
    return alleles.select(
        "chrom", "pos", "ref", "alt", "variant_type", "vcf_source_id",
        F.lit(0.0).cast("float").alias("allele_freq"),
        F.when(qual > 0, qual).otherwise(F.lit(0.0)).cast("float").alias("qual"),
    )


def sort_variants(variants: DataFrame) -> DataFrame:
    return variants.orderBy("chrom", "pos", "variant_type")


def at_positions(records: DataFrame, positions: DataFrame) -> DataFrame:
    """Records whose (chrom, pos) is in a position list."""
    return semi_join(records, positions, ["chrom", "pos"], records.columns)
