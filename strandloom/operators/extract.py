"""Reads around variants to methylation sites (Level 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.config import RunConfig
from strandloom.functions import alignment as A, basemods as B, sites as S
from strandloom.operators.reads import fetchable_reads, with_haplotype, with_span
from strandloom.operators.sweep import first_reads
from strandloom.schema import SITE_COLUMNS, VARIANT_KEY
from strandloom.session import materialize
from strandloom.sources.bam import TILE_BITS, Tiles, tile_runs


def variant_windows(variants: DataFrame, window: int) -> DataFrame:
    """Search window of each distinct variant; repeated variant rows become ``copies``."""
    pos0 = F.col("somatic_pos") - 1
    return (
        variants.groupBy(*VARIANT_KEY).agg(F.count("*").alias("copies"))
        .withColumnRenamed("pos", "somatic_pos")
        .withColumn("low0", F.greatest(pos0 - window, F.lit(0)))
        .withColumn("high0", pos0 + window)
    )


def window_tiles(variants: DataFrame, window: int, bits: int = TILE_BITS) -> Tiles:
    """Runs of genome tiles that the windows touch; see ``tile_runs``."""
    return tile_runs(variant_windows(variants, window), "low0", "high0", bits)


#: Columns of a variant that travel with its reads.
HIT = ["somatic_pos", "ref", "alt", "variant_type", "vcf_source_id", "copies"]


def touching_tiles(reads: DataFrame, windows: DataFrame, bits: int = TILE_BITS) -> DataFrame:
    """Reads in a genome tile of 2**``bits`` bases that a window touches: all that may overlap one, and few others.

    Each chromosome has a list that names, for every tile, the next touched one. The lists are broadcast:
    they are as long as the genome, whatever the number of windows.
    """
    tile = lambda c: F.shiftright(c, bits)
    touched = windows.select("chrom", F.explode(
        F.sequence(tile(F.col("low0")), tile(F.col("high0") - 1))).alias("tile")).distinct()
    # Between two touched tiles all point to the second.
    order = F.array_sort(F.collect_set("tile"))
    runs = touched.groupBy("chrom").agg(order.alias("tiles"))
    before = F.concat(F.array(F.lit(-1)), F.slice("tiles", F.lit(1), F.size("tiles") - 1))
    lists = runs.select("chrom", F.flatten(F.transform(
        F.arrays_zip(before.alias("before"), F.col("tiles").alias("tile")),
        lambda t: F.array_repeat(t["tile"], t["tile"] - t["before"]))).alias("_next"))
    following = F.get("_next", tile(F.col("start0")))
    return reads.join(F.broadcast(lists), "chrom").where(following <= tile(F.col("end0") - 1)).select(*reads.columns)


def _admitted(
    reads: DataFrame, variants: DataFrame, window: int, max_depth: int, over: bool
) -> tuple[DataFrame, DataFrame]:
    """Fetchable reads in touched tiles, numbered by ``_read`` and written once; (read, variant) pairs in reach,
    at most ``max_depth`` reads per variant and sample, all of them or those that reach ``over`` the variant."""
    windows = materialize(
        variant_windows(variants, window).withColumn("_pos0", F.col("somatic_pos") - 1), "windows")
    spans = with_span(fetchable_reads(reads)).withColumnRenamed("rname", "chrom")
    numbered = touching_tiles(spans, windows).withColumn("_read", F.monotonically_increasing_id())
    spans = materialize(numbered.sortWithinPartitions("chrom", "start0"), "reads")
    narrow = spans.select("_read", "chrom", "start0", "end0", "bam_source_id", "ord")
    order = [F.col("ord.block"), F.col("ord.row")]
    point = "_pos0" if over else None
    return spans, first_reads(narrow, windows, max_depth, order, 2 * window, point=point)


def reads_near_variants(
    reads: DataFrame, variants: DataFrame, window: int, max_depth: int
) -> DataFrame:
    """(read, variant) pairs in reach, at most ``max_depth`` reads per variant and sample.

    Reads are admitted in coordinate order. Duplicates and failed reads still count here; they
    leave only afterwards. The source is read and decoded a single time.
    """
    spans, pairs = _admitted(reads, variants, window, max_depth, over=False)
    return spans.join(pairs.select("_read", *HIT), "_read").drop("_read")


def reads_with_variants(
    reads: DataFrame, variants: DataFrame, window: int, max_depth: int
) -> DataFrame:
    """The usable reads that reach over a variant they were admitted for, each once, with those variants as ``hits``.

    Admission looks at narrow columns only. A read's variants are put together and written before the wide
    columns meet them, so the CIGAR and the modification tags of a read are decoded once, however many variants it has.
    """
    spans, pairs = _admitted(reads, variants, window, max_depth, over=True)
    hits = materialize(pairs.groupBy("_read").agg(F.collect_list(F.struct(*HIT)).alias("hits")), "admitted")
    return spans.where(S.is_usable(F.col("flag"))).join(hits, "_read").drop("_read")


def allele_support(hits: DataFrame) -> DataFrame:
    """Read base at the variant and the allele it supports; undecided reads leave.

    Reads that do not reach over the variant leave first, by their span alone. The call is made as
    a list of at most one entry and then unpacked. So the CIGAR is walked once per pair, after the
    join: a plain filter on the result would be pushed into the join condition, with a copy of the
    walk for each use.
    """
    index = A.query_index_at(F.col("cigar"), F.col("pos"), F.col("somatic_pos"))
    placed = F.filter(F.array(index), lambda i: i >= 0)
    based = F.transform(placed, lambda i: A.base_at(F.col("seq"), i))
    called = F.transform(based, lambda base: F.struct(
        base.alias("somatic_base_at_variant"),
        S.allele_type(base, F.col("ref"), F.col("alt")).alias("somatic_allele_type"),
    ))
    decided = F.filter(called, lambda call: call["somatic_allele_type"] != "unknown")
    pos0 = F.col("somatic_pos") - 1
    reaching = hits.where((F.col("start0") <= pos0) & (F.col("end0") > pos0))
    return reaching.select("*", F.inline(decided))


def sites_of_reads(reads: DataFrame, window: int, high: float, low: float) -> DataFrame:
    """Sites of reads with their variants (``hits``): calls within the window of each variant whose ref or alt the
    read supports."""
    around = B.calls_around(
        "seq", "flag", "pos", "cigar", "mm", "ml",
        F.transform("hits", lambda h: F.struct(h["somatic_pos"], h["ref"], h["alt"])), F.lit(window),
    )
    hit = F.get("hits", F.col("_call.hit"))
    decoded = (
        with_haplotype(reads).where(F.col("mm").isNotNull())
        .select("chrom", "bam_source_id", "haplotype_tag", "flag", F.col("qname").alias("read_id"), "hits",
                around.alias("_calls"))
        .select("*", F.explode("_calls").alias("_call")).drop("_calls")
        .select("*", *(hit[c].alias(c) for c in HIT))
        .withColumn("somatic_base_at_variant", F.col("_call.base"))
        .withColumn("somatic_allele_type", S.allele_type(F.col("_call.base"), F.col("ref"), F.col("alt")))
        .withColumn("methyl_pos", F.col("_call.ref_pos"))
        .withColumn("meth_call", S.call_probability(F.col("_call.qual")))
        .withColumn("meth_state", S.meth_state(F.col("meth_call"), high, low))
        .withColumn("strand", S.strand(F.col("flag")))
    )
    repeated = decoded.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*SITE_COLUMNS)


def methylation_sites(reads: DataFrame, variants: DataFrame, config: RunConfig) -> DataFrame:
    """Level 1: every methylation call of every read that supports an allele of a variant."""
    found = reads_with_variants(reads, variants, config.window_size, config.max_read_depth)
    return sites_of_reads(
        found, config.window_size, config.meth_high_threshold, config.meth_low_threshold
    )
