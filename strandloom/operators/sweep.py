"""The first reads over every window, found in one pass over strips of the genome.

A window belongs to the strip it begins in; a read goes, by its few numbers only, to every strip whose windows it
may reach. So each window meets all of its reads in one place. There the reads of a sample are laid in
order; a running maximum of their ends and their starts bound the stretch a window has to look at, and the window
takes from it until it is full. Reads beyond the limit are never paired with anything.

A crowded strip is cut into parts by read, each part gives its first reads, and the parts' are ranked together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strandloom.operators.balance import BROADCAST_ROWS
from strandloom.session import materialize

STRIP_BITS = 20
#: Reads in one part of a strip.
PART_READS = 500_000
#: Candidates that a task looks at together.
AT_ONCE = 2_000_000


def first_hits(
    ends: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, cap: int, at_once: int = AT_ONCE
) -> tuple[np.ndarray, np.ndarray]:
    """(window, read) numbers: of the reads ``first`` up to ``last`` of each window, in order, the first ``cap``
    that end beyond its ``low``."""
    at, need = first.copy(), np.full(len(first), cap, np.int64)
    windows, reads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        open_ = np.flatnonzero((at < last) & (need > 0))
        if not len(open_):
            return np.concatenate(windows), np.concatenate(reads)
        take = np.minimum(last[open_] - at[open_], np.maximum(2 * need[open_], 64))
        now = max(1, int(np.searchsorted(np.cumsum(take), at_once, "right")))
        open_, take = open_[:now], take[:now]
        who = np.repeat(open_, take)
        read = at[who] + np.arange(len(who)) - np.repeat(np.cumsum(take) - take, take)
        hit = ends[read] > low[who]
        who, read = who[hit], read[hit]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        fits = rank < need[who]
        windows.append(who[fits])
        reads.append(read[fits])
        at[open_] += take
        np.subtract.at(need, who[fits], 1)


def _sweep(
    items: pa.Table, windows: pa.Table, cap: int, order: list[str], out: list[str], point: str | None
) -> pa.Table:
    """Pairs of one part of a strip; with ``point``, of them those whose read covers it."""
    number = lambda table, name: np.array(pc.fill_null(table[name].cast(pa.int64()), -1))
    low, high = number(windows, "low0"), number(windows, "high0")
    start, end = number(items, "start0"), number(items, "end0")
    places = [number(items, name) for name in order]
    samples = items["_sample"].combine_chunks().dictionary_encode().indices
    samples = np.array(pc.fill_null(samples, -1))
    found = [], []
    for sample in np.unique(samples):
        own = np.flatnonzero(samples == sample)
        own = own[np.lexsort([p[own] for p in reversed(places)] + [start[own]])]
        reach = np.maximum.accumulate(end[own])
        pairs = first_hits(end[own], low, np.searchsorted(reach, low, "right"), np.searchsorted(start[own], high), cap)
        read, over = own[pairs[1]], pairs[0]
        if point:
            at = number(windows, point)[over]
            covers = (start[read] <= at) & (end[read] > at)
            read, over = read[covers], over[covers]
        found[0].append(read)
        found[1].append(over)
    reads, over = (pa.array(np.concatenate([np.zeros(0, np.int64), *f])) for f in found)
    return pa.table({name: items[name].take(reads) if name in items.column_names else windows[name].take(over)
                     for name in out})


def first_reads(
    reads: DataFrame, windows: DataFrame, cap: int, order: list[Column], width: int, sample: str = "bam_source_id",
    point: str | None = None, strip_bits: int = STRIP_BITS, part_reads: int = PART_READS,
) -> DataFrame:
    """(read, window) pairs on one chromosome whose half-open intervals intersect: of each window and sample the
    first ``cap`` reads by (start0, ``order``).

    ``reads`` (chrom, start0, end0, the sample and whatever else is to be kept; read twice, so a stored table) and
    ``windows`` (chrom, low0, high0 and others; distinct rows, none wider than ``width``) share no column but the
    chromosome. Reads without a chromosome or a length take no part; without a sample they form one of their own.
    ``order`` gives whole numbers that no two reads of a window share. With ``point``, a 0-based position in each
    window, reads that do not cover it use up the limit but are not returned.

    Strips are as many as the genome is long, so what is known about them is small whatever the number of reads.
    """
    names = [f"_order{i}" for i in range(len(order))]
    strip = lambda c: F.shiftright(c, strip_bits)
    windows = windows.withColumn("_strip", strip(F.col("low0")))
    columns = [c for c in windows.columns if c != "_strip"]
    touched = F.broadcast(windows.select("chrom", "_strip").distinct())
    least = F.greatest(F.col("start0") - width + 1, F.lit(0))
    placed = (
        reads.where(F.col("chrom").isNotNull() & (F.col("end0") > F.col("start0")))
        .select("*", *(c.cast("long").alias(n) for c, n in zip(order, names)), F.col(sample).alias("_sample"))
        .withColumn("_strip", F.explode(F.sequence(strip(least), strip(F.col("end0") - 1))))
        .join(touched, ["chrom", "_strip"]))
    crowded = materialize(
        placed.groupBy("chrom", "_strip").agg(F.count("*").alias("_n")).where(F.col("_n") > part_reads)
        .select("chrom", "_strip", F.ceil(F.col("_n") / part_reads).cast("int").alias("_parts")), "crowded-strips")
    split = not crowded.isEmpty()
    if split:
        few = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
        parts = F.coalesce("_parts", F.lit(1))
        placed = placed.join(few, ["chrom", "_strip"], "left").withColumn(
            "_part", F.pmod(F.xxhash64(*names), parts).cast("int")).drop("_parts")
        windows = windows.join(few, ["chrom", "_strip"], "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    else:
        placed, windows = placed.withColumn("_part", F.lit(0)), windows.withColumn("_part", F.lit(0))
    own = [c for c in reads.columns if c != "chrom"]
    out = [*own, *names, *columns] if split else [*own, *columns]
    kinds = {f.name: f.dataType for f in [*placed.schema, *windows.schema]}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in out])
    keys = ["chrom", "_strip", "_part"]
    pairs = placed.groupBy(*keys).cogroup(windows.groupBy(*keys)).applyInArrow(
        lambda items, over: _sweep(items, over, cap, names, out, None if split else point), schema)
    if not split:
        return pairs
    place = Window.partitionBy(*columns, sample).orderBy("start0", *names)
    ranked = pairs.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= cap).drop("_rank", *names)
    if point is None:
        return ranked
    return ranked.where((F.col("start0") <= F.col(point)) & (F.col("end0") > F.col(point)))
