"""Tumor/normal contrast, detail features and their TP/FP comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.functions import numeric as N, sites as S
from strandloom.schema import CONTRAST_KEY

LABELS = ["FP", "TP"]
CONTRAST = ["normal", "tumor", "delta"]


def labelled(tp: DataFrame, fp: DataFrame) -> DataFrame:
    """Stack two call sets under the labels TP and FP."""
    return tp.withColumn("label", F.lit("TP")).unionByName(
        fp.withColumn("label", F.lit("FP")), allowMissingColumns=True
    )


def distinct_labelled(tp: DataFrame, fp: DataFrame) -> DataFrame:
    """As ``labelled``, without the duplicate rows of either set."""
    return labelled(tp.dropDuplicates(), fp.dropDuplicates())


def pivot_delta(summary: DataFrame, within: list[str] | None = None) -> DataFrame:
    """``normal``, ``tumor`` and ``delta`` = tumor - normal per variant, allele and haplotype.

    A table that already has the three columns passes unchanged.
    """
    if set(CONTRAST) <= set(summary.columns):
        return summary
    missing = {"bam_source_id", "mean_methylation"} - set(summary.columns)
    if missing:
        raise KeyError(f"cannot build the contrast, missing columns: {sorted(missing)}")
    value = F.col("mean_methylation").cast("double")
    side = lambda name: F.avg(F.when(F.col("bam_source_id") == name, value)).alias(name)
    return (
        summary.where(value.isNotNull())
        .groupBy(*(within or []), *CONTRAST_KEY).agg(side("normal"), side("tumor"))
        .withColumn("delta", F.col("tumor") - F.col("normal"))
    )


def require_both_samples(contrast: DataFrame) -> DataFrame:
    """Fail when one sample has no value anywhere."""
    seen = contrast.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in ("normal", "tumor")]).first()
    absent = [c for c in ("normal", "tumor") if not seen[c]]
    if absent:
        raise KeyError(f"no values for: {absent}")
    return contrast


def detail_features(
    sites: DataFrame,
    within: list[str] | None = None,
    names: tuple[str, str, str] = (
        "supporting_read_count", "methyl_sites_count", "mean_methylation"
    ),
) -> DataFrame:
    """Distinct reads, distinct positions and mean call, both samples pooled.

    Rows are first folded per position and, apart from that, per read: no row is multiplied, and a
    frequent key is spread over its positions and reads.
    """
    reads, positions, mean = names
    key = [*(within or []), *CONTRAST_KEY]
    call = F.col("meth_call").cast("double")
    none, known = F.lit(0).cast("long"), lambda c: F.col(c).isNotNull().cast("long")
    by_position = sites.groupBy(*key, "methyl_pos").agg(
        F.sum(call).alias("_sum"), F.count(call).alias("_calls")
    ).select(*key, none.alias("_reads"), known("methyl_pos").alias("_positions"), "_sum", "_calls")
    by_read = sites.select(*key, "read_id").distinct().select(
        *key, known("read_id").alias("_reads"), none.alias("_positions"),
        F.lit(None).cast("double").alias("_sum"), none.alias("_calls"),
    )
    return by_position.unionByName(by_read).groupBy(*key).agg(
        F.sum("_reads").alias(reads), F.sum("_positions").alias(positions),
        N.ratio(F.sum("_sum"), F.sum("_calls")).alias(mean),
    )


GRID_NAMES = ("read_count_detail", "site_count_detail", "mean_meth_detail")


def merged_features(
    contrast: DataFrame, features: DataFrame, within: list[str] | None = None
) -> DataFrame:
    """Inner join of contrast and features.

    Both inputs are grouped by the join key, so the join reuses their partitioning. Only key and
    contrast columns are taken from the left side: a summary that carries its own counts then
    cannot collide with the feature columns.
    """
    key = [*(within or []), *CONTRAST_KEY]
    return contrast.select(*key, *CONTRAST).join(features, key)


def crosstab(df: DataFrame, column: str) -> DataFrame:
    """Counts of each value by label, zero where a label lacks the value."""
    count = lambda label: F.count_if(F.col("label") == label).alias(label)
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(*[count(x) for x in LABELS])


def with_asm_mode(contrast: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Adds ``asm_mode``; text that is not a number counts as missing."""
    number = lambda c: F.col(c).try_cast("double")
    return contrast.withColumn("asm_mode", S.asm_mode(number("normal"), number("tumor"), low, high))


def proportions(counts: DataFrame, column: str) -> DataFrame:
    """Share of each label within a value, and of each value within a label."""
    total = counts.select(*[F.sum(x).alias(x) for x in LABELS])
    row_total = F.col("FP") + F.col("TP")
    return counts.select(
        column, *LABELS,
        *[N.ratio(F.col(x), row_total).alias(f"{x}_share") for x in LABELS],
        *[N.ratio(F.col(x), total.select(x).scalar()).alias(f"{x}_fraction") for x in LABELS],
    )


def chi_square(counts: DataFrame) -> DataFrame:
    """Independence test of a two-column crosstab: ``chi2``, ``dof``, ``p_value``, ``n``.

    One global aggregate suffices: with row sums R and column sums C the statistic is
    N * (sum O^2 / (R * C) - 1), so no row needs to meet the totals. With one degree of freedom
    every |O - E| is equal and the continuity correction follows from the same sums. An empty
    margin makes the test undefined and gives NULL.
    """
    fp, tp = F.col("FP").cast("double"), F.col("TP").cast("double")
    row = fp + tp
    sums = counts.agg(
        F.count("*").alias("k"),
        F.sum(fp).alias("c_fp"), F.sum(tp).alias("c_tp"), F.min(row).alias("least"),
        F.sum(N.ratio(fp * fp, row)).alias("q_fp"), F.sum(N.ratio(tp * tp, row)).alias("q_tp"),
        F.sum(N.ratio(F.lit(1.0), row)).alias("inverse"),
    )
    c_fp, c_tp = F.col("c_fp"), F.col("c_tp")
    total = c_fp + c_tp
    defined = (c_fp > 0) & (c_tp > 0) & (F.col("least") > 0)
    plain = F.greatest(
        total * (N.ratio(F.col("q_fp"), c_fp) + N.ratio(F.col("q_tp"), c_tp) - 1), F.lit(0.0)
    )
    weights = total * F.col("inverse") * (N.ratio(F.lit(1.0), c_fp) + N.ratio(F.lit(1.0), c_tp))
    gap = F.sqrt(plain / weights)
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), 2) * weights
    dof = (F.col("k") - 1).cast("long")
    stat = sums.select(
        F.when(defined, F.when(dof == 1, corrected).when(dof > 1, plain).otherwise(0.0))
        .alias("chi2"),
        dof.alias("dof"), total.cast("long").alias("n"),
    )
    return stat.select("chi2", "dof", N.chi2_upper_p("chi2", "dof").alias("p_value"), "n")


def expected_counts(counts: DataFrame, column: str) -> DataFrame:
    """Counts expected under independence, per value and label."""
    total = counts.select(
        *[F.sum(x).alias(x) for x in LABELS], F.sum(F.col("FP") + F.col("TP")).alias("n")
    )
    row = F.col("FP") + F.col("TP")
    return counts.select(column, *[
        N.ratio(
            row * total.select(F.col(x).cast("double")).scalar(), total.select("n").scalar()
        ).alias(f"expected_{x}")
        for x in LABELS
    ])
