"""Report writers: the four levels of a run, and result tables of the comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.config import RunConfig
from strandloom.functions.numeric import fixed
from strandloom.operators.summary import in_report_order, run_parameters
from strandloom.schema import SITE_COLUMNS, SUMMARY_COLUMNS, SUMMARY_KEY

# File names and section titles of a run's reports.
GLOBAL_FILE = "global_summary_metrics.tsv"
LEVEL1_FILE = "level1_raw_methylation_details.tsv"
LEVEL2_FILE = "level2_somatic_variant_methylation_summary.tsv"
LEVEL3_FILE = "level3_haplotype_group_statistics.tsv"
PARAMETER_TITLE = "# 參數"
METRIC_TITLE = "# 統計數值"


def write_tsv(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """Folder of tab-separated parts, each with a header. ``NA`` is written by the caller."""
    (
        df.write.mode(mode).option("sep", "\t").option("header", True)
        .option("emptyValue", "").option("quote", "\u0000")
        .option("compression", "gzip" if gzip else "none").csv(path)
    )


def write_lines(spark: SparkSession, lines: list[str], path: str, mode: str = "errorifexists") -> None:
    """One small text file."""
    rows = spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1)
    rows.write.mode(mode).text(path)


def level1_text(sites: DataFrame) -> DataFrame:
    return sites.withColumn("meth_call", fixed(F.col("meth_call"), 4)).select(*SITE_COLUMNS)


def level2_text(summary: DataFrame) -> DataFrame:
    shown = summary.withColumn("mean_methylation", fixed(F.col("mean_methylation"), 4))
    return in_report_order(shown.select(*SUMMARY_COLUMNS), SUMMARY_KEY)


def level3_text(stats: DataFrame) -> DataFrame:
    """Fixed-point text; a VCF without values shows NA, a group without a partner 0 and 1."""
    shown = stats.withColumns({
        c: F.coalesce(fixed(F.col(f"`{c}`"), 4), F.lit("NA"))
        for c in stats.columns if c.endswith("_mean_methylation")
    })
    if "difference" in stats.columns:
        shown = shown.withColumns({
            "difference": fixed(F.coalesce("difference", F.lit(0.0)), 4),
            "p_value": F.when(~F.col("is_comparable"), "1.000000").otherwise(
                F.coalesce(fixed(F.col("p_value"), 6), F.lit("nan"))
            ),
        }).drop("is_comparable")
    return in_report_order(shown, ["haplotype_group", "bam_source", "variant_type_group"])


def metric_lines(config: RunConfig, metrics: list[tuple[str, str]]) -> list[str]:
    return [
        PARAMETER_TITLE, "parameter_name\tparameter_value",
        *[f"{k}\t{v}" for k, v in run_parameters(config)],
        "", METRIC_TITLE, "metric_name\tmetric_value",
        *[f"{k}\t{v}" for k, v in sorted(metrics)],
    ]


def write_levels(
    spark: SparkSession, folder: str, config: RunConfig, sites: DataFrame, summary: DataFrame,
    stats: DataFrame, metrics: DataFrame, mode: str = "errorifexists",
) -> None:
    """Levels 0 to 3 of one analysis under ``folder``; the metrics are a handful of rows."""
    gz = config.gzip_output
    suffix = ".gz" if gz else ""
    rows = [(r["name"], r["value"]) for r in metrics.where(~F.col("name").endswith("_site_rows")).collect()]
    write_lines(spark, metric_lines(config, rows), f"{folder}/{GLOBAL_FILE}", mode)
    write_tsv(level1_text(sites), f"{folder}/{LEVEL1_FILE}{suffix}", gz, mode)
    write_tsv(level2_text(summary), f"{folder}/{LEVEL2_FILE}{suffix}", gz, mode)
    write_tsv(level3_text(stats), f"{folder}/{LEVEL3_FILE}", False, mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """Small result table as a single part."""
    df.coalesce(1).write.mode(mode).option("header", True).option("sep", sep).csv(path)


def count_matrix(grid: DataFrame, value: str, columns: list[int]) -> DataFrame:
    """Retention counts as a matrix: one row per site minimum, one column per read minimum."""
    return (
        grid.groupBy("min_cpg").pivot("min_reads", sorted(set(columns))).agg(F.first(value))
        .orderBy("min_cpg")
    )


def chi_square_lines(test: DataFrame, expected: DataFrame, column: str) -> list[str]:
    """Text report of an independence test."""
    row = test.first()
    shown = lambda x, spec: "nan" if x is None else format(x, spec)
    lines = [
        f"chi2 = {shown(row['chi2'], '.4f')}", f"p-value = {shown(row['p_value'], '.3g')}",
        f"dof = {row['dof']}", "", "expected frequencies:",
    ]
    for r in expected.orderBy(column).collect():
        lines.append(
            "  " + "\t".join(shown(r[f"expected_{x}"], ".6g") for x in ("FP", "TP"))
        )
    return lines


def write_vcf_lines(lines: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """Variant file lines in their original order, header first: the parts in turn are the file."""
    ordered = lines.orderBy(F.desc("is_header"), "ord").select("line")
    ordered.write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)
