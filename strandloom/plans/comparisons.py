"""TP/FP comparisons on the result tables of two call sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators import contrast as C, grids as G
from strandloom.operators.classify import evaluate
from strandloom.operators.describe import (
    correlation_matrix, describe, descriptive_stats, histogram,
)
from strandloom.operators.tests import feature_tests, stat_tests
from strandloom.schema import CONTRAST_KEY, FEATURES
from strandloom.session import materialize
from strandloom.sinks.reports import (
    chi_square_lines, count_matrix, write_csv, write_lines,
)


@dataclass(frozen=True)
class CallSets:
    """Level 2 and, where needed, Level 1 tables of the TP and FP call sets."""

    tp_summary: DataFrame
    fp_summary: DataFrame
    tp_sites: DataFrame | None = None
    fp_sites: DataFrame | None = None


def labelled_contrast(sets: CallSets, both_samples: bool = True) -> DataFrame:
    sides = [C.pivot_delta(s) for s in (sets.tp_summary, sets.fp_summary)]
    if both_samples:
        sides = [C.require_both_samples(s) for s in sides]
    columns = [*CONTRAST_KEY, *C.CONTRAST]
    return C.labelled(*[s.select(*columns) for s in sides])


def labelled_features(
    sets: CallSets, names: tuple[str, str, str] | None = None, both_samples: bool = True
) -> DataFrame:
    """Contrast joined with detail features, both call sets in one pass by label."""
    wanted = [*CONTRAST_KEY, "methyl_pos", "meth_call", "read_id"]
    details = C.labelled(sets.tp_sites.select(*wanted), sets.fp_sites.select(*wanted))
    options = {"names": names} if names else {}
    return C.merged_features(
        labelled_contrast(sets, both_samples), C.detail_features(details, ["label"], **options),
        ["label"],
    )


def full_analysis(
    spark: SparkSession, sets: CallSets, out: str, alpha: float = 0.05, mode: str = "errorifexists"
) -> None:
    """Descriptive tables, tests, correlations, plot data and classifier scores."""
    df = materialize(labelled_features(sets), "features")
    write_csv(descriptive_stats(df, FEATURES), f"{out}/descriptive/descriptive_stats.csv", mode)
    write_csv(histogram(df, FEATURES, 30), f"{out}/descriptive/histograms.csv", mode)
    write_csv(stat_tests(df, FEATURES, alpha), f"{out}/stat_tests/stat_tests.csv", mode)
    write_csv(describe(df, FEATURES), f"{out}/stat_tests/quartiles.csv", mode)
    write_csv(correlation_matrix(df, FEATURES), f"{out}/corr_heatmaps/correlations.csv", mode)
    result = evaluate(df, FEATURES, [*CONTRAST_KEY, "label"])
    write_csv(result.metrics, f"{out}/classification/metrics.csv", mode)
    write_csv(result.coefficients, f"{out}/classification/feature_coefficients.csv", mode)
    result.roc.select("threshold", "fpr", "tpr").write.mode(mode).option("header", True).csv(
        f"{out}/classification/roc_curve.csv"
    )


def grid_analysis(
    sets: CallSets, out: str, normal_ths=G.NORMAL_THS, delta_ths=G.DELTA_THS,
    read_ths=G.READ_THS, mode: str = "errorifexists",
) -> None:
    """TPR and FPR over normal, delta and read thresholds."""
    df = labelled_features(sets, C.GRID_NAMES, both_samples=False)
    grid = G.rate_grid(df, normal_ths, delta_ths, read_ths)
    write_csv(
        grid.orderBy("read_th", "normal_th", "delta_th"), f"{out}/threshold_grid_results.csv", mode
    )


def retention_analysis(
    sets: CallSets, out: str, min_reads=G.MIN_READS, min_cpg=G.MIN_CPG, mode: str = "errorifexists"
) -> None:
    """Rows kept over read and site minimums, as two matrices and one long table with rates."""
    grid = materialize(
        G.retention_grid(C.labelled(sets.tp_summary, sets.fp_summary), min_reads, min_cpg),
        "retention",
    )
    write_csv(count_matrix(grid, "tp_count", min_reads), f"{out}/tp_counts.csv", mode, "\t")
    write_csv(count_matrix(grid, "fp_count", min_reads), f"{out}/fp_counts.csv", mode, "\t")
    write_csv(grid.orderBy("min_cpg", "min_reads"), f"{out}/retention_rates.csv", mode)


def haplotype_analysis(
    spark: SparkSession, sets: CallSets, prefix: str, low: float = 0.2, high: float = 0.8,
    mode: str = "errorifexists",
) -> None:
    """Haplotype and mode counts by label with independence tests, and plot data."""
    df = materialize(C.with_asm_mode(labelled_contrast(sets), low, high), "contrast")
    for column, name in (("haplotype_tag", "haplotype"), ("asm_mode", "asm_mode")):
        counts = C.crosstab(df, column)
        write_csv(counts.orderBy(column), f"{prefix}_{name}_counts.tsv", mode, "\t")
        write_lines(
            spark,
            chi_square_lines(C.chi_square(counts), C.expected_counts(counts, column), column),
            f"{prefix}_{name}_chi2.txt", mode,
        )
        write_csv(C.proportions(counts, column).orderBy(column), f"{prefix}_{name}_proportions.tsv",
                  mode, "\t")
    values = [*C.CONTRAST]
    write_csv(describe(df, values), f"{prefix}_distribution.tsv", mode, "\t")
    write_csv(histogram(df, values, 50, shared=True), f"{prefix}_histograms.tsv", mode, "\t")


def feature_comparison(
    tp: DataFrame, fp: DataFrame, features: list[str], out: str, group_by: str | None = None,
    n_boot: int = 1000, seed: int = 0, mode: str = "errorifexists",
) -> None:
    """Tests of each feature between two tables, optionally per group, and plot data."""
    df = C.distinct_labelled(tp, fp)
    shared = [f for f in features if f in tp.columns and f in fp.columns]
    group = group_by if group_by in tp.columns and group_by in fp.columns else None
    result = feature_tests(df, shared, group, n_boot, seed)
    write_csv(
        result.orderBy("group", "feature"), f"{out}/tp_fp_feature_stats.csv", mode
    )
    by, rows = (("label",), df) if group is None else (("label", group), df.where(F.col(group).isNotNull()))
    write_csv(describe(rows, shared, by), f"{out}/feature_distribution.csv", mode)
    write_csv(histogram(rows, shared, 50, shared=True, by=by), f"{out}/feature_histograms.csv", mode)
    if group is None:
        write_csv(correlation_matrix(df, shared), f"{out}/feature_correlation.csv", mode)
