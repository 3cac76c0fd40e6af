"""Alignment records: filters, spans and tag checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions import alignment as A, sites as S

SAMPLE_SIZE = 100
# The haplotype sample takes one record in THINNING after the first WHOLE_HEAD, SAMPLE_SIZE in all. Some 280
# records are enough for it; HEAD_SIZE is ten times that, so it is full whenever the file is long enough.
WHOLE_HEAD, THINNING = 11, 3
HEAD_SIZE = 3000


def fetchable_reads(reads: DataFrame) -> DataFrame:
    return reads.where(S.is_fetchable(F.col("flag"), F.col("mapq")))


def with_span(reads: DataFrame) -> DataFrame:
    """0-based half-open reference span; a read without aligned bases covers one position.

    Both ends are declared non-null: else a join on them would add null checks below this step,
    each with its own walk along the CIGAR. A read without a position gets an empty span.
    """
    start = F.col("pos") - 1
    span = F.greatest(A.reference_span(F.col("cigar")), F.lit(1))
    return reads.withColumn("start0", F.coalesce(start, F.lit(0))).withColumn(
        "end0", F.coalesce(start + span, F.lit(0))
    )


def with_haplotype(reads: DataFrame) -> DataFrame:
    return reads.withColumn(
        "haplotype_tag", S.haplotype_tag(F.col("hp_type"), F.col("hp_value"), F.col("orig_hp"))
    )


@dataclass(frozen=True)
class TagReport:
    """Tag counts over the first records of one sample, and over its thinned haplotype sample."""

    sampled: int
    mm: int
    ml: int
    hp: int
    ps: int
    thinned: int
    thinned_hp: int
    thinned_ps: int

    @property
    def has_methylation(self) -> bool:
        return self.mm > 0 and self.ml > 0

    @property
    def has_haplotypes(self) -> bool:
        return self.thinned_hp > 0


def tag_counts(reads: DataFrame) -> DataFrame:
    """Tags in the first SAMPLE_SIZE records by their place ``ord``; only upper-case MM and ML count.

    Sources that also read the lower-case spelling mark it in ``legacy_mm``. Each task keeps its
    first records, so only a bounded number is sorted in the end.
    """
    return _tag_flags(reads).orderBy("ord").limit(SAMPLE_SIZE).agg(
        *[F.count_if(c).alias(c) for c in ("sampled", "mm", "ml", "hp", "ps")]
    )


def _tag_flags(reads: DataFrame) -> DataFrame:
    upper = ~F.col("legacy_mm") if "legacy_mm" in reads.columns else F.lit(True)
    return reads.select(
        "ord", F.lit(True).alias("sampled"), (F.col("mm").isNotNull() & upper).alias("mm"),
        (F.col("ml").isNotNull() & upper).alias("ml"), F.col("hp_value").isNotNull().alias("hp"),
        F.col("ps").isNotNull().alias("ps"),
    )


def is_thinned(place: Column, key: Column) -> Column:
    """Whether the haplotype sample takes the record at ``place`` (from 1): a hash of ``key`` draws it."""
    return (place <= WHOLE_HEAD) | (F.pmod(F.xxhash64(key), F.lit(THINNING)) == 0)


def tag_report(reads: DataFrame) -> TagReport:
    """Both samples in one pass over the reads; windows run over HEAD_SIZE rows at most."""
    head = _tag_flags(reads).orderBy("ord").limit(HEAD_SIZE)
    in_order = Window.orderBy("ord")
    placed = head.withColumn("_place", F.row_number().over(in_order))
    taken = placed.withColumn("_taken", is_thinned(F.col("_place"), F.col("ord")))
    so_far = F.sum(F.col("_taken").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.col("_place") <= SAMPLE_SIZE
    thinned = F.col("_taken") & (F.col("_so_far") <= SAMPLE_SIZE)
    row = taken.withColumn("_so_far", so_far).agg(
        *[F.count_if(first & F.col(c)).alias(c) for c in ("sampled", "mm", "ml", "hp", "ps")],
        *[F.count_if(thinned & F.col(c)).alias(f"thinned_{c}") for c in ("sampled", "hp", "ps")],
    ).first()
    return TagReport(*row)


def samples_union(**samples: DataFrame) -> DataFrame:
    """Stack samples under their names, tumor before normal as given."""
    stacked = None
    for name, reads in samples.items():
        named = reads.withColumn("bam_source_id", F.lit(name))
        stacked = named if stacked is None else stacked.unionByName(named)
    if stacked is None:
        raise ValueError("no sample given")
    return stacked
