"""Interval joins by genome bins, and the per-variant depth limit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators.balance import attach_by_key, fits_broadcast, spread_bins
from strandloom.session import materialize

BIN_SIZE = 32768
HOT_BIN_ROWS = 100_000
STRIP_BITS = 22
RANK_PARTS = 64


def bin_size_for(reads: DataFrame, width: int, start: str = "start0", end: str = "end0") -> int:
    """Power of two near the wider of a window and the mean read, over all reads.

    The size only decides how many candidates share a bin, never which pairs are found.
    """
    mean = reads.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1.0
    wanted = min(max(width, mean, 256), 1 << 20)
    return 1 << math.ceil(math.log2(wanted))


def _with_bins(df: DataFrame, start: str, end: str, size: int, first: str) -> DataFrame:
    """One row per bin the half-open interval touches, plus its first bin."""
    low = F.floor(F.col(start) / size).cast("int")
    high = F.floor((F.col(end) - 1) / size).cast("int")
    return df.withColumn(first, low).withColumn("_bin", F.explode(F.sequence(low, high)))


def overlap_join(
    reads: DataFrame,
    windows: DataFrame,
    read_span: tuple[str, str] = ("start0", "end0"),
    window_span: tuple[str, str] = ("low0", "high0"),
    chrom: str = "chrom",
    bin_size: int | None = None,
    hot_rows: int = HOT_BIN_ROWS,
    small_windows: bool | None = None,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """All (read, window) pairs on one chromosome whose half-open intervals intersect.

    Both sides are cut into bins, so the join is an equality join on (chrom, bin). A pair that
    shares several bins is kept in the first common one only. Windows of counted, small size are
    broadcast and the reads stay where they are; otherwise both sides are shuffled and hot bins
    are split.
    """
    r0, r1 = read_span
    w0, w1 = window_span
    bin_size = bin_size or BIN_SIZE
    r = _with_bins(reads, r0, r1, bin_size, "_read_bin")
    w = _with_bins(windows, w0, w1, bin_size, "_window_bin")
    keys = [chrom, "_bin"]
    if small_windows is None:
        small_windows = fits_broadcast(w)  # as it would be broadcast: a row per bin
    if small_windows:
        pairs = r.join(F.broadcast(w), keys)
    else:
        columns = [F.col(c) for c in (spread_by or [r0, r1])]
        r, w = spread_bins(r, w, keys, hot_rows, columns)
        pairs = r.join(w, [*keys, "_part"]).drop("_part")
    return pairs.where(
        (F.col(r0) < F.col(w1)) & (F.col(r1) > F.col(w0))
        & (F.col("_bin") == F.greatest("_read_bin", "_window_bin"))
    ).drop("_bin", "_read_bin", "_window_bin")


def merged_regions(regions: DataFrame, chrom: str = "chrom", bits: int = STRIP_BITS) -> DataFrame:
    """The same positions as disjoint regions (``start``, ``end``), none longer than a strip of 2**``bits`` bases.

    Regions are cut at the borders of strips, and pieces that overlap or touch become one. Pieces of one strip
    with the same start are combined before the shuffle, so a strip holds as many as it has bases at most, however
    many regions cover it.
    """
    size = 1 << bits
    strip = lambda c: F.shiftright(c, bits)
    pieces = (
        regions.where(F.col("end") > F.col("start"))
        .select(chrom, F.col("start").cast("long"), F.col("end").cast("long"))
        .withColumn("_strip", F.explode(F.sequence(strip(F.col("start")), strip(F.col("end") - 1))))
        .select(chrom, "_strip", F.greatest("start", F.col("_strip") * size).alias("start"),
                F.least("end", (F.col("_strip") + 1) * size).alias("end"))
        .groupBy(chrom, "_strip", "start").agg(F.max("end").alias("end"))
    )
    order = Window.partitionBy(chrom, "_strip").orderBy("start")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached >= F.col("start"), 0).otherwise(1)
    return (
        pieces.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
        .groupBy(chrom, "_strip", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(chrom, "start", "end")
    )


def points_in_regions(
    points: DataFrame,
    regions: DataFrame,
    position: str,
    chrom: str = "chrom",
    bin_size: int = BIN_SIZE,
    hot_rows: int = HOT_BIN_ROWS,
    small_regions: bool | None = None,
) -> DataFrame:
    """Rows of ``points`` inside at least one half-open region (``start``, ``end``).

    Regions are merged first: those that overlap give no more bins than the genome has.
    """
    r = _with_bins(merged_regions(regions, chrom), "start", "end", bin_size, "_first").drop("_first")
    p = points.withColumn("_bin", F.floor(F.col(position) / bin_size).cast("int"))
    keys = [chrom, "_bin"]
    if small_regions is None:
        small_regions = fits_broadcast(r)
    if small_regions:
        r = F.broadcast(r)
    else:
        p, r = spread_bins(p, r, keys, hot_rows, [F.col(position), F.struct(*points.columns)])
        keys = [*keys, "_part"]
    p, r = p.alias("p"), r.alias("r")
    match = F.expr(f"p.{position} >= r.start and p.{position} < r.end")
    for key in keys:
        match = match & (F.col(f"p.{key}") == F.col(f"r.{key}"))
    return p.join(r, match, "left_semi").select(*points.columns)


def depth_cutoffs(
    narrow: DataFrame, crowded: DataFrame, group: list[str], order: str, cap: int
) -> DataFrame:
    """Last admitted ``order`` value of every group in ``crowded``.

    Groups are ranked in two steps: the first ``cap`` rows of each of RANK_PARTS parts, then the
    first ``cap`` of those. No task sees more than RANK_PARTS * cap rows of a group.
    """
    rows = (
        attach_by_key(narrow, crowded, group, "_rows", [order])
        .where(F.col("_rows").isNotNull())
        .withColumn("_part", F.pmod(F.xxhash64(order), F.lit(RANK_PARTS)))
    )
    in_part = Window.partitionBy(*group, "_part").orderBy(order)
    in_group = Window.partitionBy(*group).orderBy(order)
    return (
        rows.withColumn("_rank", F.row_number().over(in_part)).where(F.col("_rank") <= cap)
        .withColumn("_rank", F.row_number().over(in_group)).where(F.col("_rank") == cap)
        .select(*group, F.col(order).alias("_cutoff"), "_rows")
    )


def limit_depth(hits: DataFrame, group: list[str], order: str, cap: int) -> DataFrame:
    """First ``cap`` rows of every group in ``order``, which must be unique within a group.

    Rows are counted per group on the narrow columns first. Without a crowded group that is all,
    and the wide rows pass untouched. Otherwise the wide rows meet a table with one row per
    crowded group; they are shuffled only if that table is too large to broadcast.
    """
    narrow = hits.select(*group, order)
    counts = narrow.groupBy(*group).agg(F.count("*").alias("_rows"))
    crowded = materialize(counts.where(F.col("_rows") > cap), "crowded-groups")
    if crowded.isEmpty():
        return hits
    cutoffs = depth_cutoffs(narrow, crowded, group, order, cap)
    return (
        attach_by_key(hits, cutoffs, group, "_rows", [order])
        .where(F.col("_cutoff").isNull() | (F.col(order) <= F.col("_cutoff")))
        .select(*hits.columns)
    )
