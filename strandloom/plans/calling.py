"""From variant and alignment files to reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.config import RunConfig
from strandloom.operators.extract import methylation_sites, window_tiles
from strandloom.operators.reads import HEAD_SIZE, samples_union, tag_report
from strandloom.operators.summary import level3_statistics
from strandloom.operators.variants import variants_from_records
from strandloom.plans.analyze import analyze
from strandloom.session import materialize, scratch
from strandloom.sinks.reports import write_levels
from strandloom.sources.alignments import read_alignments
from strandloom.sources.bam import tile_runs
from strandloom.sources.variants import read_bed, read_vcf

log = logging.getLogger("strandloom")


def load_variants(spark: SparkSession, config: RunConfig) -> DataFrame:
    """Variants of all files; with regions, indexed files are read around those only."""
    regions = read_bed(spark, config.bed_file) if config.bed_file else None
    tiles = None if regions is None else tile_runs(regions, "start", "end") or None  # no region is no limit
    records = read_vcf(spark, *config.vcf_files, tiles=tiles)
    return variants_from_records(records, config.min_allele, regions)


def load_samples(
    spark: SparkSession, config: RunConfig, variants: DataFrame | None = None
) -> DataFrame | None:
    """Both samples under their names; one without modification tags is left out.

    With ``variants``, indexed files are read around their windows only. The tag check looks at the
    first records of the whole file.
    """
    samples = {}
    tiles = None if variants is None else window_tiles(variants, config.window_size)
    for name, path in (("tumor", config.tumor_bam), ("normal", config.normal_bam)):
        if not path or path == "-":
            continue
        tags = tag_report(read_alignments(spark, path, sample=name, head=HEAD_SIZE))
        log.info("%s: %s", name, tags)
        if tags.has_methylation:
            samples[name] = read_alignments(spark, path, sample=name, tiles=tiles)
        else:
            log.warning("%s has no modification tags and is skipped", name)
    return samples_union(**samples) if samples else None


def run(spark: SparkSession, config: RunConfig, mode: str = "errorifexists") -> list[str]:
    """Run everything and write the reports; returns the folders written.

    The sites are written once, split by VCF, and every report reads its columns from there: the
    reads are decoded once for the sites, whatever the number of reports and VCFs. The tables of the run are
    deleted when its reports stand.
    """
    with scratch():
        return _run(spark, config, mode)


def _run(spark: SparkSession, config: RunConfig, mode: str) -> list[str]:
    variants = materialize(load_variants(spark, config), "variants")
    names = [
        r[0] for r in variants.select("vcf_source_id").distinct().orderBy("vcf_source_id").collect()
    ]
    reads = load_samples(spark, config, variants)
    if not names or reads is None:
        log.warning("nothing to analyse")
        return []
    sites = materialize(
        methylation_sites(reads, variants, config), "sites", partition_by=["vcf_source_id"]
    )
    folders = []
    if config.per_vcf:
        for name in names:
            folders.append(_report(
                spark, sites.where(F.col("vcf_source_id") == name), config, [name], name, mode
            ))
    else:
        folders.append(_report(spark, sites, config, names, "all", mode))
    return folders


def _report(spark, sites, config, names, folder, mode) -> str:
    result = analyze(sites, config, names)
    summary = materialize(result.summary, "summary")
    path = f"{config.outdir.rstrip('/')}/{folder}"
    write_levels(
        spark, path, config, result.sites, summary, level3_statistics(summary, names),
        result.metrics, mode,
    )
    return path
