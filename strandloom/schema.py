"""Column layouts of the tables that move between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the exchanged files.
SITE_COLUMNS = [
    "chrom", "methyl_pos", "somatic_pos", "variant_type", "vcf_source_id", "bam_source_id",
    "somatic_allele_type", "somatic_base_at_variant", "haplotype_tag", "meth_call",
    "meth_state", "strand", "read_id",
]
SUMMARY_COLUMNS = [
    "chrom", "somatic_pos", "variant_type", "vcf_source_id", "bam_source_id",
    "somatic_allele_type", "haplotype_tag", "supporting_read_count", "methyl_sites_count",
    "mean_methylation", "strand",
]

# Grouping keys.
SITE_KEY = ["chrom", "methyl_pos", "bam_source_id"]
SUMMARY_KEY = SUMMARY_COLUMNS[:7]
CONTRAST_KEY = [c for c in SUMMARY_KEY if c != "bam_source_id"]
VARIANT_KEY = ["chrom", "pos", "ref", "alt", "variant_type", "vcf_source_id"]

FEATURES = [
    "supporting_read_count", "methyl_sites_count", "mean_methylation", "normal", "tumor", "delta",
]

SITES = T.StructType([
    T.StructField("chrom", T.StringType()),
    T.StructField("methyl_pos", T.IntegerType()),
    T.StructField("somatic_pos", T.IntegerType()),
    T.StructField("variant_type", T.StringType()),
    T.StructField("vcf_source_id", T.StringType()),
    T.StructField("bam_source_id", T.StringType()),
    T.StructField("somatic_allele_type", T.StringType()),
    T.StructField("somatic_base_at_variant", T.StringType()),
    T.StructField("haplotype_tag", T.StringType()),
    T.StructField("meth_call", T.FloatType()),
    T.StructField("meth_state", T.StringType()),
    T.StructField("strand", T.StringType()),
    T.StructField("read_id", T.StringType()),
])

SUMMARY = T.StructType([
    T.StructField("chrom", T.StringType()),
    T.StructField("somatic_pos", T.IntegerType()),
    T.StructField("variant_type", T.StringType()),
    T.StructField("vcf_source_id", T.StringType()),
    T.StructField("bam_source_id", T.StringType()),
    T.StructField("somatic_allele_type", T.StringType()),
    T.StructField("haplotype_tag", T.StringType()),
    T.StructField("supporting_read_count", T.IntegerType()),
    T.StructField("methyl_sites_count", T.IntegerType()),
    T.StructField("mean_methylation", T.FloatType()),
    T.StructField("strand", T.StringType()),
])

# ``ord`` is the record's place in its file: (block, row), comparable within one file.
FILE_ORDER = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("row", T.LongType()),
])

READS = T.StructType([
    T.StructField("bam_source_id", T.StringType()),
    T.StructField("ord", FILE_ORDER),
    T.StructField("qname", T.StringType()),
    T.StructField("flag", T.IntegerType()),
    T.StructField("rname", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("mapq", T.IntegerType()),
    T.StructField("cigar", T.StringType()),
    T.StructField("seq", T.StringType()),
    T.StructField("mm", T.StringType()),
    T.StructField("ml", T.ArrayType(T.IntegerType())),
    T.StructField("hp_type", T.StringType()),
    T.StructField("hp_value", T.StringType()),
    T.StructField("orig_hp", T.StringType()),
    T.StructField("ps", T.StringType()),
    T.StructField("legacy_mm", T.BooleanType()),
])
