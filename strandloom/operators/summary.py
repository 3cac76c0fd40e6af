"""Site filter, per-variant summary (Level 2), haplotype statistics (Level 3), run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.config import RunConfig
from strandloom.functions import numeric as N, sites as S
from strandloom.operators.balance import attach_by_key
from strandloom.schema import SITE_KEY, SUMMARY_COLUMNS, SUMMARY_KEY


def strand_covered_sites(
    sites: DataFrame, min_reads: int, within: list[str] | None = None
) -> DataFrame:
    """Rows of sites that have at least ``min_reads`` rows on both strands.

    Counts are rows, over all variants, alleles and haplotypes of a sample. ``within`` adds key
    columns, such as the VCF, that are to be judged on their own. The counts are combined before
    the shuffle, and a site that owns a large share of the rows does not gather on one task.
    """
    if min_reads <= 0:
        return sites
    key = [*SITE_KEY, *(within or [])]
    covered = (
        sites.groupBy(*key)
        .agg(
            F.count_if(F.col("strand") == "+").alias("_plus"),
            F.count_if(F.col("strand") == "-").alias("_minus"),
            F.count("*").alias("_rows"),
        )
        .where((F.col("_plus") >= min_reads) & (F.col("_minus") >= min_reads))
        .select(*key, "_rows")
    )
    spread_by = [c for c in ("read_id", "somatic_pos", "meth_call") if c in sites.columns]
    return (
        attach_by_key(sites, covered, key, "_rows", spread_by)
        .where(F.col("_rows").isNotNull()).drop("_rows")
    )


def majority_strand(plus: Column, minus: Column) -> Column:
    return F.when(plus > minus, "+").when(minus > plus, "-").otherwise(".")


def level2_summary(sites: DataFrame) -> DataFrame:
    """One row per variant, sample, allele and haplotype.

    ``supporting_read_count`` counts distinct reads, ``methyl_sites_count`` counts rows. The
    distinct count shuffles by (key, read), so a large group is spread over its reads.
    """
    plus = F.count_if(F.col("strand") == "+")
    minus = F.count_if(F.col("strand") == "-")
    return (
        sites.groupBy(*SUMMARY_KEY)
        .agg(
            F.count_distinct("read_id").cast("int").alias("supporting_read_count"),
            F.count("*").cast("int").alias("methyl_sites_count"),
            F.avg(F.col("meth_call").cast("double")).cast("float").alias("mean_methylation"),
            majority_strand(plus, minus).alias("strand"),
        )
        .select(*SUMMARY_COLUMNS)
    )


def in_report_order(df: DataFrame, key: list[str]) -> DataFrame:
    """Byte order of the key columns joined by colons; used when writing only."""
    return df.orderBy(F.concat_ws(":", *[F.col(c).cast("string") for c in key]))


def vcf_ids(df: DataFrame) -> list[str]:
    """Distinct VCF names in order; one per input file."""
    return [r[0] for r in df.select("vcf_source_id").distinct().orderBy("vcf_source_id").collect()]


def level3_statistics(
    summary: DataFrame, vcfs: list[str] | None = None, within: list[str] | None = None
) -> DataFrame:
    """Mean of Level 2 means per haplotype, sample and variant group, one column per VCF.

    With two or more VCFs the first two by name are compared. ``is_comparable`` tells whether
    both have values; without them ``difference`` and ``p_value`` are NULL here.
    """
    vcfs = sorted(vcfs) if vcfs is not None else vcf_ids(summary)
    value = F.col("mean_methylation").cast("double")
    moments = (
        summary.groupBy(
            *(within or []),
            F.col("haplotype_tag").alias("haplotype_group"),
            F.col("bam_source_id").alias("bam_source"),
            S.variant_group(F.col("variant_type")).alias("variant_type_group"),
        )
        .pivot("vcf_source_id", vcfs)
        .agg(F.avg(value).alias("avg"), F.var_samp(value).alias("var"), F.count(value).alias("n"))
    )
    group = [*(within or []), "haplotype_group", "bam_source", "variant_type_group"]
    part = lambda vcf, name: F.col(f"`{vcf}_{name}`")
    means = [part(v, "avg").alias(f"{v}_mean_methylation") for v in vcfs]
    if len(vcfs) < 2:
        return moments.select(*group, *means)
    a, b = vcfs[:2]
    p = N.approximate_p(
        part(a, "avg"), part(a, "var"), part(a, "n"), part(b, "avg"), part(b, "var"), part(b, "n")
    )
    both = part(a, "avg").isNotNull() & part(b, "avg").isNotNull()
    return moments.select(
        *group, *means,
        F.when(both, part(a, "avg") - part(b, "avg")).alias("difference"),
        F.when(both, p).alias("p_value"),
        both.alias("is_comparable"),
    )


def run_parameters(config: RunConfig) -> list[tuple[str, str]]:
    """Echo of the run parameters, in name order."""
    vcfs = config.vcf_files
    values = {
        "vcf_files": "None" if not vcfs else vcfs[0] if len(vcfs) == 1 else f"{len(vcfs)} files",
        "tumor_bam": config.tumor_bam,
        "normal_bam": config.normal_bam,
        "ref_file": config.ref_file,
        "bed_file": config.bed_file or "None",
        "window_size": str(config.window_size),
        "meth_high_threshold": f"{config.meth_high_threshold:f}",
        "meth_low_threshold": f"{config.meth_low_threshold:f}",
        "min_allele": f"{config.min_allele:f}",
        "min_strand_reads": str(config.min_strand_reads),
        "threads": str(config.threads),
    }
    return sorted(values.items())


def global_metrics(sites: DataFrame) -> DataFrame:
    """Run metrics as (name, value) text rows, from the sites before the strand filter.

    ``<vcf>_total_variants`` counts site rows and ``<vcf>_site_rows`` states the same number under
    its proper name. A sample with low calls only has a count of 0 and a mean of 0.0000.
    """
    variant = F.struct("chrom", "somatic_pos", "variant_type")
    per_vcf = sites.groupBy("vcf_source_id").agg(
        F.count("*").alias("rows"), F.count_distinct(variant).alias("variants")
    )
    methylated = F.col("meth_state").isin("high", "mid")
    call = F.when(methylated, F.col("meth_call").cast("double"))
    per_sample = sites.groupBy("bam_source_id").agg(
        F.count_if(methylated).alias("methylated"),
        F.count("*").alias("rows"),
        N.fixed(F.coalesce(F.avg(call), F.lit(0.0)), 4).alias("mean"),
    )

    def named(df: DataFrame, prefix: str, **columns: str) -> DataFrame:
        pairs = F.array(*[
            F.struct(
                F.concat(F.col(prefix), F.lit(suffix)).alias("name"),
                F.col(column).cast("string").alias("value"),
            )
            for suffix, column in columns.items()
        ])
        return df.select(F.inline(pairs))

    return named(
        per_vcf, "vcf_source_id",
        **{"_total_variants": "rows", "_site_rows": "rows", "_processed_variants": "variants"},
    ).unionByName(named(
        per_sample, "bam_source_id",
        **{"_methylated_site_count": "methylated", "_total_site_count": "rows",
           "_mean_methylation": "mean"},
    ))
