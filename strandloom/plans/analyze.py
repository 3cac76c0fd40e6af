"""Sites to all report levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from strandloom.config import RunConfig
from strandloom.operators.summary import (
    global_metrics, level2_summary, level3_statistics, strand_covered_sites,
)


@dataclass(frozen=True)
class Analysis:
    """The four result levels; lazy but for small tables written on the way."""

    sites: DataFrame
    summary: DataFrame
    statistics: DataFrame
    metrics: DataFrame


def analyze(
    sites: DataFrame, config: RunConfig, vcfs: list[str] | None = None
) -> Analysis:
    """Level 1 passes as it is; Levels 2 and 3 see the strand-covered sites; metrics see all.

    ``config.per_vcf`` judges strand coverage within each VCF, as in separate runs. Without it
    the VCFs are one pool and Level 3 compares them.
    """
    within = ["vcf_source_id"] if config.per_vcf else None
    covered = strand_covered_sites(sites, config.min_strand_reads, within)
    summary = level2_summary(covered)
    return Analysis(sites, summary, level3_statistics(summary, vcfs), global_metrics(sites))
