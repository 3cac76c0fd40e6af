"""Threshold grids.

Rows are reduced to the highest threshold they meet on each axis and counted per combination; that
table has at most one row per grid cell. Running sums along one axis after the other, from the highest
threshold down, then give every cell, so neither the input nor the cells are multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def parse_thresholds(text: str) -> list[int]:
    """Comma-separated whole numbers; other tokens are skipped."""
    return [int(token) for token in text.split(",") if token.strip().isdigit()]


def _level(value: Column, steps: list[float]) -> Column:
    """Number of steps at or below ``value``; NULL meets none."""
    met = F.lit(0)
    for step in steps:
        met = met + F.when(value >= F.lit(step), 1).otherwise(0)
    return met


def _grid_counts(df: DataFrame, axes: dict[str, tuple[Column, list]]) -> DataFrame:
    """Kept rows per grid cell and label, next to the totals before filtering."""
    steps = {name: sorted(set(values)) for name, (_, values) in axes.items()}
    level = {name: f"_{name}" for name in axes}
    counted = (
        df.select("label", *[_level(value, steps[name]).alias(level[name])
                             for name, (value, _) in axes.items()])
        .groupBy(*level.values())
        .agg(F.count_if(F.col("label") == "TP").alias("tp_count"),
             F.count_if(F.col("label") == "FP").alias("fp_count"))
    )
    cells = df.sparkSession.range(1).select()
    for name in axes:
        cells = cells.select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(len(steps[name])))).alias(level[name])
        )
    grid = cells.join(counted, list(level.values()), "left").fillna(0, ["tp_count", "fp_count"])
    for name in axes:
        others = [level[other] for other in axes if other != name]
        above = (
            Window.partitionBy(*others).orderBy(F.desc(level[name]))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        grid = grid.withColumns({c: F.sum(c).over(above) for c in ("tp_count", "fp_count")})
    value_of = {
        name: F.element_at(F.array(*[F.lit(v) for v in steps[name]]), F.col(level[name])).alias(name)
        for name in axes
    }
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp_count", "fp_count")])
    met_all = reduce(Column.__and__, [F.col(c) > 0 for c in level.values()])
    return grid.where(met_all).select(
        *value_of.values(), "tp_count", "fp_count",
        total.select("tp_count").scalar().alias("tp_total"),
        total.select("fp_count").scalar().alias("fp_total"),
    )


def retention_grid(
    summary: DataFrame, min_reads: list[int], min_cpg: list[int]
) -> DataFrame:
    """TP and FP rows, and their shares, kept by each pair of minimum reads and sites."""
    counts = _grid_counts(summary, {
        "min_cpg": (F.col("methyl_sites_count"), min_cpg),
        "min_reads": (F.col("supporting_read_count"), min_reads),
    })
    return counts.select(
        "min_cpg", "min_reads", "tp_count", "fp_count",
        F.when(F.col("tp_total") > 0, F.col("tp_count") / F.col("tp_total")).alias("tp_rate"),
        F.when(F.col("fp_total") > 0, F.col("fp_count") / F.col("fp_total")).alias("fp_rate"),
    )


def rate_grid(
    features: DataFrame,
    normal_ths: list[float],
    delta_ths: list[float],
    read_ths: list[int],
    reads: str = "read_count_detail",
) -> DataFrame:
    """TPR and FPR of every triple of normal, |delta| and read thresholds.

    A row without delta meets no delta threshold but stays in the denominators.
    """
    counts = _grid_counts(features, {
        "read_th": (F.col(reads), read_ths),
        "normal_th": (F.col("normal"), [float(x) for x in normal_ths]),
        "delta_th": (F.abs(F.col("delta")), [float(x) for x in delta_ths]),
    })
    return counts.select(
        "read_th", "normal_th", "delta_th",
        F.when(F.col("tp_total") > 0, F.col("tp_count") / F.col("tp_total")).alias("TPR"),
        F.when(F.col("fp_total") > 0, F.col("fp_count") / F.col("fp_total")).alias("FPR"),
    )


# Default thresholds of the two grids.
NORMAL_THS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]
DELTA_THS = [0.0, 0.05, 0.1, 0.15, 0.2]
READ_THS = [0, 2, 5, 10]
MIN_READS = [0, 5, 10, 15, 20, 25, 30, 40, 50]
MIN_CPG = [0, 1, 2, 3, 4, 5, 10]
